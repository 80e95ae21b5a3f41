"""Visually identical text with different characters (problem 9).

Each text gets one consistent form: look-alike characters mapped, invisible ones dropped,
accents composed. The form depends on the text alone, so two runs over different corpora
agree. Texts of equal form are a class; its canonical member is the form itself and its
name the least key, joined back to all members.

Method: composition in place of grouping under an accent-sensitive collation. After the
map only joined and separate accents are left to settle, which composition does exactly;
a grouping by collation keys gave the same classes for ten times the CPU, as it sorts
whole texts, and needed composition after it. Here only hashes of 16 bytes are shuffled.

The map is built by rule from the Unicode data: full- and half-width forms, ligatures,
radicals, numerals and unit signs of the same look, kinds of space, and invisible
characters. Joined letters go by their base, so that accents over look-alikes meet. Only
the look-alike letters of other scripts are fixed values. Raised, circled, squared and
mathematical styles look different and stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.session import stage

# fixed values: letters of other scripts and the Latin letters they look like
SCRIPT_LOOKALIKES = (
    ("асԁеһіјӏорԛѕԝхуѵ", "acdehijlopqswxyv"),  # Cyrillic, small
    ("АВСԌЕНІЈКМОРԚЅТԜХУ", "ABCGEHIJKMOPQSTWXY"),  # Cyrillic, capital
    ("αονρυϲϳ", "aovpucj"),  # Greek, small
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek, capital
    ("օսոհցՕՍ", "ounhgOU"),  # Armenian
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏏᏒᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZbRVSLCPKB"),  # Cherokee
    ("ⲂⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ", "BHIKMNOoPpCcTYX"),  # Coptic
    ("ɡɑı", "gai"),  # Latin letters with a second shape
)

# fixed values: characters without ink besides the format controls
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# fixed values: format controls that are visible
VISIBLE_FORMATS = "؀؁؂؃؄؅۝܏࣢\U000110bd\U000110cd"
# fixed values: half-width sound marks and the combining marks they stand for
SOUND_MARKS = {"ﾞ": "゙", "ﾟ": "゚"}

#: Code points that have no compatibility form and are left out when the map is built.
_PLAIN_RANGES = ((0x3400, 0xA000), (0xAC00, 0xE000), (0x20000, 0x2F800), (0x30000, 0xE0000), (0xE01F0, 0x110000))


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    """What each character becomes: another, several, or nothing; those that stay are left out."""
    letters = {a: b for old, new in SCRIPT_LOOKALIKES for a, b in zip(old, new, strict=True)}
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    gone = [chr(n) for n in (*range(0x09), *range(0x0E, 0x20), *range(0x7F, 0xA0)) if n != 0x85]
    for c in map(chr, (n for n in range(0xA0, 0x110000) if not any(a <= n < b for a, b in _PLAIN_RANGES))):
        kind, parts = unicodedata.category(c), unicodedata.decomposition(c)
        plain = unicodedata.normalize("NFKC", c)
        if c in letters:
            one[c] = letters[c]
        elif (kind == "Cf" and c not in VISIBLE_FORMATS) or c in INVISIBLE or "︀" <= c <= "️" or c >= "\U000e0100":
            gone.append(c)
        elif kind == "Zs":
            one[c] = " "
        elif c in SOUND_MARKS:
            one[c] = SOUND_MARKS[c]
        elif not parts.startswith("<"):
            base, *marks = unicodedata.normalize("NFD", c)  # a joined letter goes by its base, or is a second code of the same sign
            plain = unicodedata.normalize("NFC", letters.get(base, base) + "".join(marks))
            if parts and plain != c:
                if len(plain) == 1:
                    one[c] = letters.get(plain, plain)
                elif base in letters:
                    several[c] = plain
        elif parts.split()[0] in ("<wide>", "<narrow>", "<compat>", "<noBreak>") and " " not in plain:
            if len(plain) == 1:
                one[c] = letters.get(plain, plain)
            elif all(unicodedata.category(x)[0] == "L" or x == "°" for x in plain):
                several[c] = plain
    return {ord(c): v for c, v in (*one.items(), *several.items(), *((c, None) for c in gone))}


_CONTROLS = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
_INK = re.compile(r"[^\s\x00-\x20\x7f-\xa0]")


def form(text: str) -> str:
    """The consistent form of a text."""
    if text.isascii():
        return _CONTROLS.sub("", text)
    return unicodedata.normalize("NFC", text.translate(_table()))


def visible(form_: str) -> bool:
    """Whether a form has a character with ink."""
    return bool(_INK.search(form_)) and any(unicodedata.category(c)[0] not in "ZC" for c in form_)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array([None if t is None else form(t) for t in batch.column("_text").to_pylist()], pa.string())], names=["_key", "canonical"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda t: hashlib.md5(t.encode()).digest()
    for batch in batches:
        known = batch.filter(pc.and_(pc.is_valid(batch.column("_key")), pc.is_valid(batch.column("_text"))))
        keep, texts, forms = [], [], []
        for i, t in enumerate(known.column("_text").to_pylist()):
            f = form(t)
            if visible(f):
                keep.append(i)
                texts.append(digest(t))
                forms.append(texts[-1] if f == t else digest(f))
        yield pa.RecordBatch.from_arrays([known.column("_key").take(pa.array(keep, pa.int64())), pa.array(texts, pa.binary()), pa.array(forms, pa.binary())], names=["_key", "text_hash", "_class"])


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``class_id`` (smallest key of the class), ``text_hash`` and ``mixed`` for rows with a visible text.

    Texts share a class if their forms are equal. ``mixed`` tells whether the class holds
    different texts. Null texts, texts without a visible character and null keys are left
    out; repeated rows share a class; other columns are dropped; an empty table gives an
    empty result.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    # three short columns, written once, so that the texts are read and mapped once
    hashed = stage(rows.mapInArrow(_hashes, f"_key {rows.schema['_key'].dataType.simpleString()}, text_hash binary, _class binary"), "forms")
    classes = hashed.groupBy("_class").agg(F.min("_key").alias("class_id"), (F.min("text_hash") != F.max("text_hash")).alias("mixed"))
    # the class under another expression: shuffled anew, the join can split a class that many rows share
    named = classes.select(F.substring("_class", 1, 16).alias("_class"), "class_id", "mixed")
    return hashed.join(named, "_class").select(F.col("_key").alias(key), "class_id", "text_hash", "mixed")


def canonical_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``canonical`` for every row: one form for all texts that look the same, whatever else the table holds.

    A null text stays null; a text without a visible character becomes its mapped form.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    made = rows.mapInArrow(_forms, f"_key {rows.schema['_key'].dataType.simpleString()}, canonical string")
    return made.withColumnRenamed("_key", key)


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All pairs of keys, smaller first, whose texts differ but look the same: ``<key>_a``, ``<key>_b``."""
    rows = lookalike_classes(df, key, text).where("mixed").select(key, "class_id", "text_hash").distinct()
    a = rows.select(F.col(key).alias(f"{key}_a"), "class_id", F.col("text_hash").alias("_ha"))
    b = rows.select(F.col(key).alias(f"{key}_b"), "class_id", F.col("text_hash").alias("_hb"))
    return a.join(b, "class_id").where((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("_ha") != F.col("_hb"))).select(f"{key}_a", f"{key}_b").distinct()
