"""Encoding and decoding with a stored BPE vocabulary, in batched numpy merge rounds."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_KNOWN_WORDS = 100_000
CHARACTERS_AT_ONCE = 1 << 21
NO_RANK = np.int64(1) << 40

# Fixed value: bytes that stand for themselves in a byte-level vocabulary; the others
# follow in order from character 256 on.
PRINTABLE_BYTES = (range(33, 127), range(161, 173), range(174, 256))


def byte_characters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte."""
    plain = {byte for span in PRINTABLE_BYTES for byte in span}
    others = iter(range(256, 512))
    return [chr(byte) if byte in plain else chr(next(others)) for byte in range(256)]


def undated(character: str) -> bool:
    """Whether tables of different Unicode versions may disagree on a character.

    That goes for those that Python's tables do not have, and for combining marks beyond the first
    block.
    """
    import unicodedata

    mark = character >= "\u0370" and unicodedata.combining(character) > 0
    return mark or unicodedata.category(character) == "Cn"


class Vocabulary:
    """A word-level BPE model read from a tokenizer file (JSON).

    What the file may ask for is what the word BPE asks for: NFC, white space and lower case
    as normalisation, a pattern that finds the words, bytes as symbols, a suffix on the
    last one, merges by rank. The merges are kept as sorted pair keys.
    """

    def __init__(self, path: str):
        import regex

        stored = json.loads(Path(path).read_text(encoding="utf-8"))
        model = stored["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {item["content"]: item["id"] for item in stored["added_tokens"]}
        pieces = {number: piece for piece, number in ids.items()}
        pieces |= {number: piece for piece, number in self.special.items()}
        self.pieces = pieces
        characters = byte_characters()
        self.inner = np.array([ids[character] for character in characters], np.int64)
        self.last = np.array([ids[character + suffix] for character in characters], np.int64)
        self.size = max(pieces) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.at_once = self._at_once(left, right, made)[order]
        split = next(
            step["pattern"]["Regex"]
            for step in stored["pre_tokenizer"]["pretokenizers"]
            if step["type"] == "Split"
        )
        self.words = regex.compile(split, regex.V1)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.known: dict[str | int, tuple[str, str, int]] = {}
        self.path, self.library = path, None
        self.bytes = {character: byte for byte, character in enumerate(characters)}
        self.dated: set[str] = set()

    def _at_once(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Merges whose result takes part in later merges only.

        All places of such a pair can be merged in one round: no pair that arises can rank before
        it.
        """
        ranks = np.arange(len(made))
        first_use = np.full(self.size, len(made) + 1, np.int64)
        np.minimum.at(first_use, left, ranks)
        np.minimum.at(first_use, right, ranks)
        return first_use[made] > ranks

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of pairs and their place among the sorted keys, by binary search."""
        pairs = left * self.size + right
        place = np.searchsorted(self.keys, pairs)
        place[place == len(self.keys)] = 0
        return np.where(self.keys[place] == pairs, self.ranks[place], NO_RANK), place

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words in one flat array, and where each word starts in it.

        Each round merges, in every word at once, the pair of lowest rank: all its
        places if nothing that arises can rank before it, otherwise the first. Only the pairs
        next to a merge are looked up again. Words that have no pair left drop out of the rounds.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbols), NO_RANK)
        place = np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], place[inner] = self._find(symbols[inner], symbols[inner + 1])
        done_symbols, done_words = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[:-1] != word[1:])))
            lowest = np.minimum.reduceat(rank, starts)
            lowest = np.repeat(lowest, np.diff(np.append(starts, len(symbols))))
            active = lowest < NO_RANK
            if not active.all():
                done_symbols.append(symbols[~active])
                done_words.append(word[~active])
                symbols, word, rank, place, lowest = (
                    values[active] for values in (symbols, word, rank, place, lowest)
                )
            if len(symbols):
                symbols, word, rank, place = self._merged(symbols, word, rank, place, lowest)
        flat = np.concatenate(done_symbols) if done_symbols else np.empty(0, np.int64)
        owner = np.concatenate(done_words) if done_words else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def _merged(
        self,
        symbols: np.ndarray,
        word: np.ndarray,
        rank: np.ndarray,
        place: np.ndarray,
        lowest: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One round: the lowest pair of each word becomes one symbol."""
        hits = np.flatnonzero(rank == lowest)
        first = np.concatenate(([True], word[hits[1:]] != word[hits[:-1]]))
        hits = hits[first | self.at_once[place[hits]]]
        # Of overlapping places, as in "aaa", every second one counts, from the left.
        new_run = np.concatenate(([True], np.diff(hits) > 1))
        number = np.arange(len(hits))
        run_start = np.maximum.accumulate(np.where(new_run, number, 0))
        hits = hits[(number - run_start) % 2 == 0]
        symbols[hits] = self.made[place[hits]]
        stays = np.ones(len(symbols), bool)
        stays[hits + 1] = False
        symbols, word, rank, place = (values[stays] for values in (symbols, word, rank, place))
        at = hits - np.arange(len(hits))
        rank[at] = NO_RANK
        touched = np.concatenate([at, at[at > 0] - 1])
        touched = touched[touched + 1 < len(symbols)]
        touched = touched[word[touched] == word[touched + 1]]
        rank[touched], place[touched] = self._find(symbols[touched], symbols[touched + 1])
        return symbols, word, rank, place

    def normalised(self, text: str) -> str:
        """NFC and lower case, one character at a time; white space only separates words."""
        import unicodedata

        text = unicodedata.normalize("NFC", text)
        if text.isascii() or "Σ" not in text:
            return text.lower()
        return "".join(character.lower() for character in text)

    def _is_dated(self, text: str) -> bool:
        new = set(text) - self.dated
        found = {character for character in new if undated(character)}
        self.dated |= new - found
        return not found

    def plain_words(self, text: str) -> list[str]:
        """The words of a text without special tokens.

        The library that the file was made for has Unicode tables of its own. Texts with characters
        on which versions may disagree are normalised and split by that library.
        """
        if text.isascii() or self._is_dated(text):
            return self.words.findall(self.normalised(text))
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(text)
        words = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self.bytes.__getitem__, word)).decode() for word, _ in words]

    def split(self, text: str) -> Iterator[str | int]:
        """The words of a text in order, and the ids of special tokens written out in it."""
        start = 0
        for found in self.specials.finditer(text):
            yield from self.plain_words(text[start : found.start()])
            yield self.special[found.group()]
            start = found.end()
        yield from self.plain_words(text[start:])

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words that are not known yet, all together, in bounded blocks."""
        if len(self.known) > MOST_KNOWN_WORDS:
            self.known.clear()
        missing = [word for word in words if word not in self.known]
        start = 0
        while start < len(missing):
            end, characters = start, 0
            while end < len(missing) and (end == start or characters < CHARACTERS_AT_ONCE):
                characters += len(missing[end])
                end += 1
            some = missing[start:end]
            encoded = [word.encode("utf-8", "surrogatepass") for word in some]
            ids, starts = self.encode_words(encoded)
            ids, starts = ids.tolist(), starts.tolist()
            for word, a, b in zip(some, starts, starts[1:], strict=False):
                own = ids[a:b]
                texts = " ".join(map(str, own)), " ".join(map(self.pieces.__getitem__, own))
                self.known[word] = (*texts, len(own))
            start = end

    def encode(self, texts: Sequence[str | None]) -> list[tuple[str, str, int]]:
        """Per text its ids as decimal text, the decoded text and the number of ids."""
        split = [list(self.split(text or "")) for text in texts]
        self.learn({word for words in split for word in words if isinstance(word, str)})
        for content, number in self.special.items():
            self.known[number] = (str(number), content, 1)
        known = self.known
        found = []
        for words in split:
            own = [known[word] for word in words]
            found.append(
                (
                    " ".join([ids for ids, _, _ in own]),
                    " ".join([text for _, text, _ in own]),
                    sum([count for _, _, count in own]),
                )
            )
        return found

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: their pieces, one blank between them."""
        return " ".join(self.pieces[number] for number in ids)


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each Python worker.

    Functions sent by value come with fresh module variables for each task, so it is
    kept under a module name of its own, which lasts as long as the worker.
    """
    import types

    name = "trendline_vocabularies"
    kept = vars(sys.modules.setdefault(name, types.ModuleType(name)))
    if path not in kept:
        kept[path] = Vocabulary(path)
    return kept[path]


def _slices(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of bounded size, so that few words are held at a time."""
    start = size = 0
    for place, text in enumerate(texts):
        size += len(text or "")
        if size >= CHARACTERS_AT_ONCE:
            yield slice(start, place + 1)
            start, size = place + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


Encoded = list[tuple[str, str, int]]


def _with_columns(
    docs: DataFrame,
    path: str,
    text: str,
    added: StructType,
    make: Callable[[Encoded], list[pa.Array]],
) -> DataFrame:
    """Adds columns made from the encoded texts; own columns of the same names give way."""
    own = [name for name in docs.columns if name not in added.names]
    entries = docs.select(
        F.struct(F.lit(0), *[docs[name] for name in own]).alias("_doc"), docs[text].alias("_text")
    )
    schema = entries.select("_doc").schema
    for field in added.fields:
        schema = schema.add(field)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for batch in batches:
            texts = batch["_text"].to_pylist()
            for part in _slices(texts):
                piece = batch["_doc"].slice(part.start, part.stop - part.start)
                new = make(model.encode(texts[part]))
                yield pa.RecordBatch.from_arrays([piece, *new], names)

    found = entries.mapInArrow(run, schema)
    return found.select(*[F.col("_doc")[name].alias(name) for name in own], *added.names)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of every whole text, as an array in column ``ids``.

    NULL counts as empty and has no ids. Other columns stay; one named like the new one gives way.
    """

    def make(found: Encoded) -> list[pa.Array]:
        counts = np.array([0, *(count for _, _, count in found)], np.int32)
        flat = " ".join([numbers for numbers, _, count in found if count])
        numbers = pa.array(np.fromstring(flat, np.int32, sep=" "))
        ends = pa.array(np.cumsum(counts, dtype=np.int32))
        return [pa.ListArray.from_arrays(ends, numbers)]

    added = StructType().add(ids, ArrayType(IntegerType()))
    return _with_columns(docs, path, text, added, make)


def token_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """What a round trip gives, in place of the text: ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256``.
    """

    def make(found: Encoded) -> list[pa.Array]:
        from hashlib import sha256

        def digests(texts: list[str]) -> pa.Array:
            return pa.array([sha256(text.encode()).hexdigest() for text in texts], pa.string())

        return [
            pa.array([count for _, _, count in found], pa.int64()),
            digests([ids for ids, _, _ in found]),
            digests([decoded for _, decoded, _ in found]),
        ]

    added = StructType().add("n_tokens", LongType())
    added = added.add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    return _with_columns(docs, path, text, added, make).drop(text)
