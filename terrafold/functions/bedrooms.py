"""Bedroom and registration vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies of the source systems.
COUNTS = ("Studio", "1BR", "2BR", "3BR", "4BR", "5BR", "6BR+")
REG_TYPES = {"Off-Plan Properties": "OffPlan", "Existing Properties": "Ready"}
PROPERTY_TYPES = ("Unit", "Villa")
CONTRACT_TYPES = {"Studio": "Studio", "Duplex": "Duplex", "Penthouse": "Penthouse", "Room": "Room", "Villa": "Villa"}
OFFPLAN_WORDS = (
    "off-plan", "offplan", "off plan", "under construction", "launching", "launch", "pre-launch", "new project",
    "handover", "completion", "expected", "phase", "payment plan",
)
READY_WORDS = ("ready", "completed", "finished", "move-in", "immediate", "existing", "resale", "secondary")
NUMBER_WORDS = ("one", "two", "three", "four", "five")


def of_count(n: Column) -> Column:
    """0 is a studio, six and more are one class."""
    return F.when(n == 0, "Studio").when(n >= 6, "6BR+").when(n > 0, F.concat(n.cast("int").cast("string"), F.lit("BR")))


def from_rooms(c: Column) -> Column:
    """Rooms of a transaction (F18): ``3 B/R`` by its number; offices, shops and the like give NULL."""
    number = F.regexp_extract(c, r"^(\d+) B/R$", 1)
    return (
        F.when(number != "", of_count(F.try_to_number(number, F.lit("999")).cast("int")))
        .when(c == "Studio", "Studio")
        .when(c == "PENTHOUSE", "Penthouse")
        .when(c == "Single Room", "Room")
    )


def from_contract(c: Column) -> Column:
    """Sub-type of a rent contract (F18): ``2 bed rooms+hall[+Maids Room]``, or a named
    residential type; everything else is commercial and gives NULL."""
    text = F.trim(c)
    number = F.regexp_extract(text, r"^(\d{1,2}) ?bed rooms?\+hall(?:\+Maids Room)?$", 1)
    one = F.lower(text) == "1bed room+hall"
    named = F.element_at(F.create_map(*[F.lit(x) for kv in CONTRACT_TYPES.items() for x in kv]), text)
    return F.when(one, "1BR").when(number != "", of_count(F.try_to_number(number, F.lit("99")).cast("int"))).otherwise(named)


def to_number(c: Column) -> Column:
    """Bedrooms as a number where that is factual (F18); duplexes, penthouses and villas give NULL."""
    pairs = [x for n, name in enumerate(COUNTS) for x in (F.lit(name), F.lit(n))]
    return F.try_element_at(F.create_map(*pairs, F.lit("Room"), F.lit(0)), c)


def normalise(c: Column, unknown: str = "null") -> Column:
    """A typed bedroom (F19): number words, then any number, then key words.

    ``unknown="input"`` returns the input where nothing fits.
    """
    text = F.lower(F.trim(c))
    bare = F.trim(F.regexp_replace(text, r"bedrooms?", ""))
    written = F.lit(None).cast("string")
    for n, word in enumerate(NUMBER_WORDS, 1):
        written = F.when(text.isin(f"{word} bed", f"{word} bedroom", word) | (bare == word), f"{n}BR").otherwise(written)
    number = F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d{1,6})", 1), F.lit("")), F.lit("999999")).cast("int")
    named = (
        F.when(text.contains("studio"), "Studio")
        .when(text.isin("room", "single room"), "Room")
        .when(text.contains("penthouse") | text.contains("ph"), "Penthouse")
    )
    found = F.when(text != "", F.coalesce(written, of_count(number), named))
    return F.coalesce(found, c) if unknown == "input" else found


def from_text(c: Column) -> Column:
    """Bedrooms named in a free text (F17): a studio, else the least count before ``bed`` or ``br``.

    Counts are digits to 7, or words to five before ``bed``; five and more are one class.
    """
    text = F.lower(c)
    found = F.when(text.contains("studio"), "Studio")
    for n in range(1, 8):
        counted = text.rlike(rf"{n}\s*b(?:ed|r)")
        if n <= len(NUMBER_WORDS):
            counted = counted | text.rlike(rf"{NUMBER_WORDS[n - 1]}\s*bed")
        found = found.when(counted, f"{n}BR" if n < 5 else "5BR+")
    return found


def reg_type(query: Column, handover_months: Column, developer: Column) -> Column:
    """Registration type of a request (F39), in this order of evidence."""
    text = F.lower(F.coalesce(query, F.lit("")))
    any_of = lambda ws: text.rlike("|".join(rf"\Q{w}\E" for w in ws))
    return (
        F.when(any_of(OFFPLAN_WORDS), "OffPlan")
        .when(any_of(READY_WORDS), "Ready")
        .when(F.coalesce(handover_months, F.lit(0)) != 0, "OffPlan")
        .when(F.coalesce(developer, F.lit("")) != "", "OffPlan")
    )
