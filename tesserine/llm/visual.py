"""One consistent form for texts that look the same but differ in their characters.

The form is the composed compatibility normalisation with full case folding,
every space mapped to the plain one, default-ignorable characters removed and
letters of another script that stand for Latin look-alikes replaced. It is
computed once for each distinct value that a worker meets.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Cyrillic, Cherokee and Greek letters and the Latin letters they look like.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝӏАВЕЅІЈКМНОРСТУХԌԚԜ" "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ" "οΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳͿ",
        "aeopcyxijshdqwlABESIJKMHOPCTYXGQW" "ABCDEHJKLMPRSTVWZ" "oABEZHIKMNOPTYXjJ",
        strict=True,
    )
)
# Greek letters that look like Latin ones only among Latin letters; alone they are used as such.
LOOK_ALIKES_AMONG = dict(zip("νρκιυ", "vpkiu", strict=True))
#: Letters with a mark that exist composed in both scripts.
LOOK_ALIKES |= {"ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï", "ϊ": "ï", "ό": "ó"}
#: Latin letters of other alphabets with the look of plain ones.
LOOK_ALIKES_LATIN = {"ɡ": "g", "ɑ": "a", "ı": "i"}
#: Characters that default-ignorable lists hold besides the format characters.
IGNORABLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Characters of the values whose forms a worker remembers.
REMEMBERED = 1 << 22
_LIGATURES = re.compile("[ﬀ-ﬗיִ-﷿ﹰ-ﻼĲĳǄ-ǌǱ-ǳ]")
_LINE_ENDS = "\n\r\x0b\x0c\x85  \t\x1c\x1d\x1e\x1f"


@functools.cache
def _tables() -> tuple[dict[int, str | None], frozenset[str], re.Pattern]:
    """(map of single characters, all characters worth a closer look, pattern of combining sequences)."""
    single: dict[int, str | None] = {}
    marks, composing = [], set()
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        kind = unicodedata.category(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            composing.add(chr(int(parts[1], 16)))
        if kind == "Cf" and not 0x600 <= i <= 0x605 and i not in (0x6DD, 0x70F, 0x8E2) or c in IGNORABLE:
            single[i] = None
        elif (c.isspace() or kind == "Zs") and c != " " and c not in _LINE_ENDS:
            single[i] = " "
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
            single[i] = unicodedata.normalize("NFKC", c)
        elif _LIGATURES.match(c) and unicodedata.normalize("NFKC", c) != c:
            single[i] = unicodedata.normalize("NFKC", c).strip() or c
        elif unicodedata.category(c) in ("Mn", "Mc"):
            marks.append(i)
        elif i in (0x212A, 0x212B, 0x2126, 0x1FEF, 0x37E, 0x387):  # canonical twins of plain characters
            single[i] = unicodedata.normalize("NFC", c)
    for c in LOOK_ALIKES_LATIN:
        single[ord(c)] = LOOK_ALIKES_LATIN[c]
    ranges, start = [], None
    for a, b in zip(marks, [*marks[1:], -1]):
        start = a if start is None else start
        if b != a + 1:
            ranges.append(f"{chr(start)}-{chr(a)}")
            start = None
    worth = frozenset(map(chr, single)) | frozenset(LOOK_ALIKES) | frozenset(LOOK_ALIKES_AMONG) | composing
    return single, worth, re.compile(f"[^{''.join(ranges)}][{''.join(ranges)}]+")


_WORD = re.compile(r"[^\W\d_]+(?:[^\W\d_]|[̀-ͯ])*")


def _composed(m: re.Match) -> str:
    """The sequence composed, if composing saves a character; marks are not merely put in another order."""
    s = m.group()
    n = unicodedata.normalize("NFC", s)
    return n if len(n) < len(s) else s


def _latin(m: re.Match) -> str:
    """The look-alikes of a word in Latin letters if it has a Latin letter besides, or nothing but look-alikes."""
    w = m.group()
    if not any(c in LOOK_ALIKES or c in LOOK_ALIKES_AMONG for c in w):
        return w
    if any("LATIN" in unicodedata.name(c, "") for c in w):
        # a Greek letter before or after a run of Latin ones may be a symbol; between them it is none
        inner = "".join(LOOK_ALIKES_AMONG.get(c, c) if 0 < i < len(w) - 1 else c for i, c in enumerate(w))
        return "".join(LOOK_ALIKES.get(c, c) for c in inner)
    if all(c in LOOK_ALIKES or unicodedata.combining(c) for c in w):
        return "".join(LOOK_ALIKES.get(c, c) for c in w)
    return w


def plain_look(text: str) -> str:
    """``text`` with every character or sequence that a plain one can replace without a change of look so replaced.

    Superscripts, fractions, ellipses, line breaks, vowel marks and Greek letters
    used as such stay. Idempotent; the empty text stays empty.
    """
    single, worth, sequence = _tables()
    if text.isascii() or worth.isdisjoint(text):
        return text
    out = sequence.sub(_composed, text.translate(single))
    return _WORD.sub(_latin, out)


def consistent_form(text: str) -> str:
    """The form in which texts that look the same are equal: ``plain_look``, compatibility-composed, fully case-folded, spaces squeezed."""
    return _looked_at(text)[0]


def _looked_at(text: str) -> tuple[str, bool]:
    """The consistent form, and whether its first step, which alone keeps the look, changed the text."""
    plain = plain_look(text)
    out = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", plain).casefold())
    return " ".join(out.split()), plain != text


def unify(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns, the ``form`` of ``text`` and whether its look-alike characters ``differ`` from plain ones.

    NULL gives a NULL form that does not differ. One row for each row of ``df``.
    """
    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(*[df[c].alias(n) for c, n in zip(keep, names)], df[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, bool]] = {}
        size = 0
        for batch in batches:
            encoded = pc.dictionary_encode(batch.column("text"))
            values = encoded.dictionary.to_pylist()
            for v in values:
                if v not in known:
                    known[v] = _looked_at(v)
                    size += len(v)
            forms = pa.array([known[v][0] for v in values], pa.string())
            differ = pa.array([known[v][1] for v in values], pa.bool_())
            if size > REMEMBERED:
                known, size = {}, 0
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], forms.take(encoded.indices), pc.fill_null(differ.take(encoded.indices), False)],
                [*names, "form", "differ"],
            )

    schema = source.select(*names).schema.add("form", "string").add("differ", "boolean")
    out = source.mapInArrow(run, schema)
    return out.select(*[out[n].alias(c) for n, c in zip(names, keep)], "form", "differ")
