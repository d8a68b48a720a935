"""Values that results must agree on."""

from __future__ import annotations

from datetime import date

# The age bands, closed on both sides, youngest first.
AGE_BANDS = (
    ("0_19", 0, 19),
    ("20_39", 20, 39),
    ("40_59", 40, 59),
    ("60_79", 60, 79),
    ("80_and_over", 80, 114),
)

# How many rows back the change of each band's average looks.
CHANGE_ROWS = {"80_and_over": 7, "60_79": 7, "40_59": 6, "20_39": 6, "0_19": 6}

# Fixed value: the average spans this many rows.
AVERAGE_ROWS = 7

# Fixed value: event dates before this day are typing errors.
EARLIEST_EVENT = date(2020, 1, 1)

# Fixed value: an outcome that contains this text counts.
OUTCOME_TEXT = "YES"

# The short region names, in the order of the region sheet.
REGION_SHORT_NAMES = (
    "Algoma",
    "Brant",
    "Chatham-Kent",
    "Durham",
    "Eastern",
    "Grey Bruce",
    "Haldimand-Norfolk",
    "HKPR",
    "Halton",
    "Hamilton",
    "HPE",
    "Huron-Perth",
    "KFLA",
    "Lambton",
    "LGL",
    "Middlesex-London",
    "Niagara",
    "NBPS",
    "Northwestern",
    "Ottawa",
    "Peel",
    "Peterborough",
    "Porcupine",
    "Renfrew",
    "Simcoe Muskoka",
    "Southwestern",
    "Sudbury",
    "Thunder Bay",
    "Timiskaming",
    "Toronto",
    "Unknown",
    "Waterloo",
    "WDG",
    "Windsor-Essex",
    "York",
)

# Fixed value: tokens kept of each training text.
MAX_SEQUENCE_TOKENS = 512

# Sequences per batch, batches per optimiser step.
BATCH_SIZE = 4
ACCUMULATION = 4
