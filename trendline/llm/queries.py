"""One callable per operator of this subpackage, and its oracle where SQL can state the job."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendline.llm import (
    bpe,
    chat,
    exact_dedup,
    html_text,
    language_model,
    minhash,
    mixing,
    phrases,
    quality,
    repeats,
    simhash,
    topk,
    turns,
)
from trendline.llm.common import table, word_count
from trendline.workspace import written_once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_mix_sources(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    sizes = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(written_once(sizes, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op1_mix_sources"] = r"""
WITH sized AS (
    SELECT doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sources
), ranked AS (
    SELECT *,
           row_number() OVER room AS place,
           sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
               ORDER BY source_size * (10 // weight), source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
           sum(weight) OVER (
               ORDER BY source_size * (10 // weight), source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
    FROM weighed
    WINDOW room AS (ORDER BY source_size * (10 // weight), source NULLS LAST)
), marked AS (
    SELECT *, 3 * source_size::DOUBLE <= rest::DOUBLE * weight / weights AS is_full FROM ranked
), targets AS (
    SELECT source, source_size,
           CASE WHEN is_full THEN 3 * source_size::DOUBLE
                ELSE (min_by(rest, place) FILTER (NOT is_full) OVER ())::DOUBLE * weight
                     / min_by(weights, place) FILTER (NOT is_full) OVER () END AS target
    FROM marked
), ordered AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
           floor(t.target + 0.5)::BIGINT AS budget,
           coalesce(sum(s.size) OVER (
               PARTITION BY s.source ORDER BY md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
             + greatest(0, least(size, budget % source_size - before))
             ELSE 0 END)::BIGINT AS taken
FROM ordered
"""


@query
def op7_exact_dedup(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = {"text_sha256": lambda text: F.sha2(exact_dedup.normalised(text), 256)}
    return exact_dedup.exact_classes(documents, digests=whole)


ORACLES["op7_exact_dedup"] = """
WITH normalised AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       text_sha256
FROM normalised
"""


@query
def op8_simhash_dedup(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(documents, shingle_words=3, most_bits=2)


@query
def op3_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors["vec_id"] % 50 == 0, k=5)


ORACLES["op3_exact_top_k"] = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id,
       (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query
def op6_bpe_digests(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.token_digests(documents, public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_chat_examples(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", marked), (-7, 1, "assistant", marked)], turns.schema
    )
    return chat.read_back(chat.expand(turns.union(extra)))


@query
def op2_quality_resampling(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.resample(documents, table(spark, sf_dir, "labels"))
    return found.select("_doc.doc_id", "log_weight", "sample_key", "kept")


@query
def op10_drop_repeats(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    left = repeats.drop_repeats(documents, length=100)
    digest = F.sha2(F.col("kept"), 256).alias("kept_sha256")
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", digest)


@query
def op5_language_model_scores(spark, sf_dir):
    return language_model.score(table(spark, sf_dir, "documents"))


@query
def op4_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op11_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_phrase_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), listed AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), sizes AS (
    SELECT lang, sum(len(words))::BIGINT AS n FROM listed GROUP BY lang
), grams AS (
    SELECT lang, size,
           unnest(list_transform(range(1, len(words) - size + 2),
                                 lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
    FROM listed, (SELECT unnest([1, 2, 3, 4]) AS size) sizes WHERE len(words) >= size
), counted AS (
    SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
    SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
           array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') AS tail
    FROM counted, (SELECT unnest([1, 2, 3]) AS k) places WHERE k < size
), scored AS (
    SELECT cuts.lang, cuts.phrase, a, k, h.f AS l, t.f AS r,
           ((2000000::HUGEINT * a) // (h.f + t.f))::BIGINT AS score
    FROM cuts JOIN counted h ON h.lang = cuts.lang AND h.phrase = head
              JOIN counted t ON t.lang = cuts.lang AND t.phrase = tail
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, f, unnest(flatten(list_transform(range(2, size), lambda s:
               list_transform(range(1, size - s + 2), lambda i:
                   array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' '))))) AS phrase
    FROM counted WHERE size > 2
), covers AS (
    SELECT lang, phrase, max(f) AS top FROM inside GROUP BY lang, phrase
), kept AS (
    SELECT lowest.* FROM lowest LEFT JOIN covers USING (lang, phrase)
    WHERE NOT coalesce(100::HUGEINT * top >= 80::HUGEINT * a, false)
)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER best <= 2000
"""


@query
def op12_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return turns.repair_report(conversations, turns.damaged(conversations))


def _edit(state: str, letter: str, cost: str, line: str | None = None) -> str:
    """SQL for a way to a state, one edit longer."""
    said = f"{state}.said" if line is None else f"list_append({state}.said, {line})"
    longer = f"{{'c': {state}.c + {cost}, 'audit': {state}.audit || '{letter}', 'said': {said}}}"
    return f"CASE WHEN {state} IS NOT NULL THEN {longer} END"


def _turn(state: str, due: str) -> str:
    """SQL for a turn put out as ``due`` after a state."""
    keep = _edit(state, "K", "flaw", "role || ':' || text")
    rerole = _edit(state, "R", "2 + flaw", f"'{due}:' || text")
    return f"CASE WHEN goes THEN NULL WHEN letter = '{due[0]}' THEN {keep} ELSE {rerole} END"


# Every state of the search keeps its cheapest way, turn by turn: nothing put out yet (z), a system
# turn (s), a user's (u) or an assistant's (a).
ORACLES["op13_conversation_repair"] = rf"""
WITH RECURSIVE drawn AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                   string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                   lambda x: ascii(x)::BIGINT)),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
                   lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS draw
    FROM conversations
), rows AS (
    SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
           CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                ELSE text END AS text,
           unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy
    FROM drawn WHERE draw <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
           CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS letter,
           NOT regexp_matches(text, '[^ 	-]') AS blank
    FROM rows
), seen AS (
    SELECT *, NOT blank AND row_number() OVER (
                  PARTITION BY conv_id, role, text ORDER BY place) > 1 AS duplicate
    FROM placed
), faults AS (
    SELECT *, blank OR duplicate AS goes,
           (NOT blank AND NOT duplicate
            AND NOT regexp_matches(text, '[.!?][ 	-]*$'))::INTEGER AS flaw
    FROM seen
), pairs AS (
    SELECT *, letter || lead(letter) OVER (PARTITION BY conv_id ORDER BY place) AS pair FROM faults
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
           sum(flaw)::BIGINT AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS places
    FROM pairs GROUP BY conv_id
), ways AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS place,
           {{'c': 0, 'audit': '', 'said': []::VARCHAR[]}} AS z,
           NULL::STRUCT(c INTEGER, audit VARCHAR, said VARCHAR[]) AS s,
           {{'c': 2, 'audit': 'I', 'said': ['user:']}} AS u,
           {{'c': 4, 'audit': 'II', 'said': ['user:', 'assistant:']}} AS a
    FROM rows
    UNION ALL
    SELECT conv_id, place, z, s, u, list_min([a, {_edit("u", "I", "2", "'assistant:'")}]) AS a
    FROM (
        SELECT conv_id, place, z, s, a, list_min([u, {_edit("z", "I", "2", "'user:'")},
               {_edit("s", "I", "2", "'user:'")}, {_edit("a", "I", "2", "'user:'")}]) AS u
        FROM (
            SELECT ways.conv_id, faults.place, {_edit("z", "D", "3")} AS z,
                   list_min([{_edit("s", "D", "3")}, CASE WHEN letter = 's' AND NOT goes
                             THEN {_edit("z", "K", "flaw", "role || ':' || text")} END]) AS s,
                   list_min([{_edit("u", "D", "3")}, {_turn("z", "user")}, {_turn("s", "user")},
                             {_turn("a", "user")}]) AS u,
                   list_min([{_edit("a", "D", "3")}, {_turn("u", "assistant")}]) AS a
            FROM ways JOIN faults ON ways.conv_id IS NOT DISTINCT FROM faults.conv_id
                                     AND faults.place = ways.place + 1
        ) moved
    ) closed
), best AS (
    SELECT ways.conv_id, list_min([z, a]) AS way, counts.*EXCLUDE (conv_id, places)
    FROM ways JOIN counts ON ways.conv_id IS NOT DISTINCT FROM counts.conv_id
    WHERE place = places
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(way.c, 0)::BIGINT AS cost,
       coalesce(way.audit, '') AS audit,
       sha256(coalesce(array_to_string(way.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
     LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id
"""


# The template wraps an assistant's text in <s> and </s>, another turn in [INST], [TEXT] and [/INST].
# A control string in a role or text, also one with backslashes in it, grows by one character.
ORACLES["op9_chat_examples"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, number, role, '</s>[INST] ok [/INST]'
    FROM (VALUES (0, 'user'), (1, 'assistant')) added(number, role)
), measured AS (
    SELECT *, len(regexp_extract_all(text, control)) AS in_text,
           len(regexp_extract_all(role, control)) AS in_role
    FROM turns, (SELECT '<\\*/?s>|\[\\*/?INST\]|\[\\*TEXT\]' AS control)
), pieces AS (
    SELECT *, CASE WHEN role = 'assistant' THEN 7 + length(text) + in_text
                   ELSE 19 + length(text) + in_text + length(role) + in_role END AS piece
    FROM measured
), prefixes AS (
    SELECT *,
           sum(piece) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                            ROWS UNBOUNDED PRECEDING) AS prefix,
           lead(turn) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NULL
               AS is_last
    FROM pieces
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), ''
                         ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(prefix) FILTER (role = 'assistant' OR is_last))::BIGINT AS formatted_chars
FROM prefixes GROUP BY conv_id
"""


ORACLES["op10_drop_repeats"] = """
WITH docs AS (
    SELECT doc_id, encode(coalesce(text, '')) AS content, octet_length(content) AS n FROM documents
), windows AS (
    SELECT doc_id, i,
           row_number() OVER (PARTITION BY digest ORDER BY doc_id, i) AS nth
    FROM (SELECT doc_id, unnest(range(1, n - 98)) AS i,
                 unnest(list_transform(range(1, n - 98),
                                       lambda i: md5_number(content[i:i + 99]))) AS digest
          FROM docs) places
), starts AS (
    SELECT doc_id, i, coalesce(i - lag(i) OVER in_doc > 100, true) AS new
    FROM windows WHERE nth > 1 WINDOW in_doc AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
    SELECT doc_id, i, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts
), spans AS (
    SELECT doc_id, min(i) AS first, max(i) + 99 AS last FROM runs GROUP BY doc_id, run
), gaps AS (
    SELECT doc_id, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) + 1 AS first,
           first - 1 AS last
    FROM spans
    UNION ALL
    SELECT doc_id, coalesce(max(spans.last), 0) + 1, any_value(n)
    FROM docs LEFT JOIN spans USING (doc_id) GROUP BY doc_id
), kept AS (
    SELECT doc_id, sha256(unhex(string_agg(hex(content[gaps.first:gaps.last]), ''
                                           ORDER BY gaps.first))) AS kept_sha256
    FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
), removed AS (
    SELECT doc_id, sum(last - first + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM docs JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
