"""Residue of templates and pages: unfilled slots, filler, error pages and script notices.

Records made from one template agree but for their slots. A chunk that is written
like a slot - a delimited name or hint, a format letter, a blank - is held against
the records of its template: where other texts have the words before and after it
side by side, the record is aligned with them and the chunk is what a slot keeps
that was not filled. What stands in many such places is a default, whatever its
form; what always stands in one sentence, which never occurs without it, belongs
to the sentence. Messages of pages and filler are whole segments that recur in
different texts. Wording is one signal of them, strong or, if the segment recurs,
weak; segments that recur nearly only on such pages belong to the page's template.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.shingles import hash_words, mix
from tesserine.runtime import stored

# The delimiters and signs that template languages and editors mark slots with.
SLOT = re.compile(
    r"""\{\{[^{}\n]+\}\}|[$\#]\{[^{}\n]+\}|\{%[^{}\n]+%\}|(?<![\w{$\#%])\{[^{}\n]+\}(?!\})|<[%?][^<>\n]+[%?]>|<<[^<>\n]+>>|<[^\W\d][^<>\n:]*>(?!:)|\[\[[^\[\]\n]+\]\]|\[(?=[^\[\]\n]*[^\W\d_])[^\[\]\n]+\]
    |%\([^()\n]+\)[a-z]|(?<!\w)%[^\W\d][\w.]*%(?!\w)|@@[^@\n]+@@|(?<!\w)__[^\W\d_][\w.]*?__(?!\w)|(?<![\d%])(?<!\d[ ])%[sd](?![\w%])
    |(?<!\w)(?:REPLACE|CHANGE|FILL)_(?:ME|THIS|IN)(?!\w)|(?<!\w)(?:TODO|TBD|FIXME)(?!\w):?|(?<!\w)X{4,}(?:\s+X{4,})*(?!\w)|(?<![\w_])_{4,}(?![\w_])|\((?:insert|enter|add|your|fill\ in|texte?|nombre|nom|name)\b[^()\n]*\)""",
    re.VERBOSE,
)
_MARKS = re.compile(r"[{<\[@%_]|X{4}|TODO|TBD|FIXME|\((?:insert|enter|add|your|fill in|texte?|nombre|nom|name)\b")
#: What a filled slot does not hold: one name, as programs write them.
NAME = re.compile(r"[=\s%?$]*(?:[^\W\d]\w*(?:[._-]\w+)+|[^\W\d]\w*)[\s%?]*")
# Words that begin or make up hints in brackets, in five languages.
HINT = re.compile(r"\W*(?:insert|enter|add|put|your|fill|type|choose|select|image:|caption|todo|platzhalter|hier|texte?\b|ins[ée]rer|à compléter|votre|su |introduzca|nombre de|nom de|name der|اسم|أدخل|ضع)", re.I)
# Names that templates give their slots, told from other words in single brackets.
NAMES = frozenset("firstname first_name lastname last_name surname name title city clinic doctor patient product date symptom company address phone email".split())
# Marks of speakers, which are no slots.
SPEAKER = frozenset("<human> <bot> <user> <assistant> <system>".split())
# The words of the classical filler text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# What editors leave in place of text.
FILLER = re.compile(
    r"""\bsample\ text\b|\byour\ (?:text|description|content|title)\ goes\ here|\bdummy\ (?:text|paragraph)\b|\bclick\ to\ edit\b|\bblah\ blah\b|\breplace\ this\ (?:paragraph|text)\b|\bwrite\ (?:two|three|a\ few|some)\b.*\bsentences\ here\b|\bfinal\ copy\ to\ follow
    |\btexte\ d['’]exemple\b|\btexte\ à\ remplacer|\bfaux[- ]texte\b|\bhier\ steht\ (?:später|bald|demnächst)\b|\bblindtext\b|\bbeispieltext\b|\btexto\ de\ (?:ejemplo|relleno|muestra)|\baquí\ va\ (?:el|su)\ texto
    |نص\ (?:تجريبي|توضيحي|بديل)|هذا\ نص\b|هنا\ (?:يوضع|يكتب)\ النص|\bcontent\ coming\ soon\b|^\W*heading\ \#+\W*$|(?:\b(?:asdf|qwer|yxcv)\b\s*){2,}""",
    re.VERBOSE | re.I,
)
#: One short word over and over.
STUTTER = re.compile(r"(?:^|(?<=\W))(\w{3,6})(?:[\s,.]+\1){3,}(?!\w)", re.I)
_SCRIPT = r"(?:java\s?script|js|scripts?|scripting|skripte?n?|جافا\s?سكريبت|البرامج\ النصية|السكربت)"
# The wording of notices that scripts are required, in five languages.
NOTICE_STRONG = re.compile(
    rf"""^(?:\W*(?:please|bitte|veuillez|por\ favor|يرجى|يُرجى)?\W*)(?:enable|activate|allow|turn\ on|switch\ on|activez|activer|autorisez|aktivieren\ sie|erlauben\ sie|active|activa|habilite|permita|تفعيل|تشغيل|السماح)\W+(?:\w+\W+){{0,4}}?ب?{_SCRIPT}(?!\w)
    |\b(?:ohne|sans|sin|without)\ {_SCRIPT}\b.*\b(?:seite|page|página|site|sitio|antwort|respuesta|réponse|angezeigt|display|view)|دون\ جافا\s?سكريبت""",
    re.VERBOSE | re.I,
)
NOTICE_MESSAGE = re.compile(
    rf"""\b(?:enable|activate|allow|turn\ on|switch\ on|activez|activer|autoriser|autorisez|aktivieren|erlauben|active|activar|activa|habilite|habilitar|permita)\W+(?:\w+\W+){{0,4}}?{_SCRIPT}\b
    |(?:تفعيل|تشغيل|السماح)\W+(?:\w+\W+){{0,2}}?(?:ب?البرامج\ النصية|جافا\s?سكريبت)
    |\b{_SCRIPT}\W+(?:\w+\W+){{0,4}}?(?:enabled|disabled|is\ off|are\ off|must\ be|est\ désactivé|désactivés?|doivent|autorisés|müssen|erlaubt\ sein|deaktiviert|estén\ permitidos|desactivado|permitidos|allowed|معطل)
    |\b(?:ohne|sans|sin|without)\ {_SCRIPT}\b|دون\ جافا\s?سكريبت|\b(?:requires|requiert|erfordert|requiere)\ {_SCRIPT}\b|\bscript\ blockers\b|\bscripts?\ or\ they\ have\ been\ disabled
    |^\W*(?:checking\ your\ browser|your\ browser\ (?:blocked|does\ not)|turn\ them\ on\ and\ reload|scripts\ and\ cookies|(?:application|app|site|page)\ only\ runs\ with)|\bonly\ runs\ with\ scripting\b|\bscripting\ is\ disabled\b""",
    re.VERBOSE | re.I | re.M,
)
NOTICE_WEAK = re.compile(rf"(?<!\w){_SCRIPT}(?!\w)|\bscript\ blockers\b|\byour\ browser\ (?:blocked|does\ not)", re.I)
# The wording of error pages, in five languages.
_HEADINGS = r"not\ found|page\ not\ found|access\ denied|bad\ gateway|gateway\ timeout|internal\ (?:server\ )?error|login\ required|request\ blocked|resource\ missing|service\ interrupted|time\ limit\ exceeded|too\ many\ requests|this\ page\ is\ gone|something\ went\ wrong|(?:whoops|oops|oups)(?:,\ that\ didn['’]t\ work)?|accès\ refusé|zugriff\ verweigert|acceso\ denegado|تم\ رفض\ الوصول"
ERROR_STRONG = re.compile(
    rf"""^\W*(?:http\s*)?(?:error|erreur|fehler|خطأ)\s*(?:code\s*)?\W*\#+(?:\W*$|\s+(?-i:[A-ZÀ-Þ]))|^\W*(?:\#+\W+)?(?:(?:forbidden|{_HEADINGS})(?:\W+\#+)?\W*$|(?:{_HEADINGS})\s+(?-i:[A-ZÀ-Þ]))
    |\bpage\ you\ (?:are\ looking\ for|requested)\b|\bdo\ not\ have\ permission\ to\ (?:view|access)\ this\b|\byour\ session\ has\ expired\b|\bservice\ (?:is\ )?temporarily\ unavailable\b|\bverify\ that\ you\ are\ human\b|\bSQLSTATE\b|\bunhandled\ exception\b|\bdatabase\ connection\ failed\b
    |\bpage\ introuvable\b|\bseite\ (?:wurde\ )?nicht\ gefunden\b|\bpágina\ no\ encontrada\b|الصفحة\ غير\ موجودة""",
    re.VERBOSE | re.I,
)
ERROR_MESSAGE = re.compile(
    r"""^\W*(?:http\s*)?(?:error|erreur|fehler|خطأ)\s*(?:code\s*)?\#+(?:\W*$|\W*[.:–—-]|\s+(?-i:[A-ZÀ-Þ؀-ۿ]))|^\W*\#+\s*[-–—:]?\s*(?:the\ page|page|not\ found|forbidden|error|gateway)
    |\bpage\ you\ (?:are\ looking\ for|requested)\b|^\W*(?:not\ found|page\ not\ found|access\ denied|forbidden|bad\ gateway|internal\ (?:server\ )?error|login\ required|request\ blocked|resource\ missing|service\ interrupted|time\ limit\ exceeded|this\ page\ is\ gone|something\ went\ wrong|whoops|too\ many\ requests)(?:\W|$)
    |\bservice\ temporarily\ unavailable\b|\bgateway\ timeout\b|\bserver\ (?:is\ unable\ to\ handle|gave\ an\ unexpected|did\ not\ (?:answer|respond))|\bhost\ did\ not\ respond\ within\b|\bSQLSTATE\b|\bdatabase\ connection\ failed\b|\bthrew\ an\ exception\b|\bunhandled\ exception\b
    |\bhave\ permission\ to\ (?:view|access)\ this\b|\byour\ session\ has\ expired\b|\bverify\ that\ you\ are\ human\b|\bverifying\ the\ connection\b|\bno\ handler\ is\ registered\b|\baddress\ you\ typed\b|\bnetwork\ has\ sent\ too\ many\b|\bcontent\ has\ been\ moved\ or\ deleted\b|\bwe\ are\ carrying\ out\ maintenance\b|\b(?:oops|whoops)\W+something\ went\ wrong\b|\bsomething\ went\ wrong\ on\ our\ side\b|\bclear\ the\ cache\ and\ repeat\b
    |\bpage\ (?:introuvable|absente)\b|\blien\ est\ rompu\b|\bcette\ adresse\ n['’]existe\ plus\b|\bserveur\ ne\ répond\ pas\b|\bservice\ est\ momentanément\ indisponible\b|^\W*accès\ refusé\b|\bpas\ les\ droits\ pour\ cette\b
    |\bseite\ (?:wurde\ )?nicht\ gefunden\b|\blink\ ist\ veraltet\b|\bdiese\ adresse\ gibt\ es\ nicht\ mehr\b|\bserver\ antwortet\ (?:zurzeit\ )?nicht\b|^\W*zugriff\ verweigert\b
    |\bpágina\ no\ encontrada\b|\benlace\ ya\ no\ existe\b|\bdirección\ solicitada\ no\ existe\b|\bservidor\ no\ responde\b|^\W*acceso\ denegado\b
    |^\W*nothing\ here\ yet\b|\b(?:will\ be\ published|coming)\ soon\b|الصفحة\ غير\ موجودة|هذا\ العنوان\ لم\ يعد|الخادم\ لا\ يستجيب|تم\ رفض\ الوصول""",
    re.VERBOSE | re.I | re.M,
)
ERROR_WEAK = re.compile(
    r"""\b(?:error|erreur|fehler)\b|خطأ|\b(?:web)?page\b|\bseite\b|\bpágina\b|صفحة|\bserver\b|\bserveur\b|\bservidor\b|خادم|\bhost\b|\bgateway\b|\bsession\b|\b(?:went|go)\ wrong\b|\b(?:denied|forbidden|blocked|timed\ out|time\ limit)\b|\bcache\b|\breload\b|\bretry\b|\brequests?\b|\bpermission\b
    |\baddress\ you\ typed\b|\bmaintenance\b|\bsign(?:ed)?[- ]in\b|\blog\ ?in\b|\b(?:moved|withdrawn|renamed)\ or\ (?:deleted|renamed|removed)\b|\bconnection\b|\bhandler\b|\bexception\b|\b(?:link|lien|enlace)\b|\b(?:adresse|dirección)\b|العنوان|\b(?:whoops|oops)\b|\bhuman\b|\b(?:accès|zugriff|acceso)\b""",
    re.VERBOSE | re.I,
)
# Strings of which a segment holds one, in lower case, if a pattern of the group is to match it.
STEMS = {
    "filler": (
        "sample text", "goes here", "dummy", "to edit", "blah", "asdf", "qwer", "yxcv", "replace this", "sentences here", "final copy", "d'exemple", "d’exemple", "à remplacer", "faux", "hier steht", "blindtext", "beispieltext", "texto de", "aquí va", "نص", "coming soon", "heading",
    ),
    "script_notice": ("javascript", "java script", "js", "script", "skript", "جافا", "النصية", "السكربت", "your browser"),
    "error_page": (
        "error", "erreur", "fehler", "خطأ", "page", "seite", "página", "صفحة", "server", "serveur", "servidor", "خادم", "host", "gateway", "session", "wrong", "denied", "forbidden", "blocked", "timed out", "time limit", "cache", "reload", "retry", "request", "permission", "address you", "maintenance", "sign in", "sign-in",
        "signed", "login", "log in", "deleted", "renamed", "removed", "connection", "handler", "exception", "link", "lien", "enlace", "adresse", "dirección", "العنوان", "whoops", "oops", "human", "accès", "zugriff", "acceso", "not found", "resource missing", "interrupted", "refusé", "verweigert", "denegado", "رفض الوصول", "unavailable",
        "sqlstate", "database", "oups", "soon", "nothing here", "introuvable", "gefunden", "encontrada", "موجودة",
    ),
}
#: Distinct texts in which a segment recurs that is a template.
RECURS = 3
#: The share of a recurring segment's texts with page residue from which on it is of the page's template.
ON_PAGES = 0.8
#: Distinct texts that have the words around a chunk side by side before the record counts as aligned with them.
ALIGNED = 2
#: Places from which on a chunk is a slot's default, if no place has more than ONE_PLACE of its distinct texts.
PLACES = 4
ONE_PLACE = 0.5
#: Bits of the table of windows and segments that are looked for in the corpus; it has 2 MB, and more in it only cost a comparison.
TABLE_BITS = 24
_DIGITS = re.compile(r"\d+")
_END = re.compile(r"(?<=[.!?؟…])\s+|\s*\n\s*")


def segments(text: str) -> list[str]:
    """Sentences and lines with numbers masked."""
    return [s for s in _END.split(_DIGITS.sub("#", text.strip())) if s]


def wording(segment: str) -> tuple[str, str]:
    """(strong, weak): the kind of residue that a segment is by its wording alone, and the one that it may be.

    A weak kind with ``message`` behind it is one if the segment recurs or is not
    the only such segment of its text; others need to recur on pages.
    """
    may = {kind for _, kinds in _stems().iter(segment.lower()) for kind in kinds}
    for kind, pattern in (("filler", FILLER), ("script_notice", NOTICE_STRONG), ("error_page", ERROR_STRONG)):
        if kind in may and pattern.search(segment):
            return kind, kind
    for kind, pattern in (("script_notice", NOTICE_MESSAGE), ("error_page", ERROR_MESSAGE)):
        if kind in may and pattern.search(segment):
            return "", f"{kind} message"
    for kind, pattern in (("script_notice", NOTICE_WEAK), ("error_page", ERROR_WEAK)):
        if kind in may and pattern.search(segment):
            return "", kind
    return "", ""


@functools.cache
def _stems():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for x in {x for stems in STEMS.values() for x in stems}:
        automaton.add_word(x, [kind for kind, stems in STEMS.items() if x in stems])
    automaton.make_automaton()
    return automaton


def filler_runs(texts: list[str]) -> np.ndarray:
    """Which texts hold five words of the classical filler text side by side, or one word four times."""
    hashed = hash_words(texts)
    known = np.isin(hashed.word, hash_words([" ".join(sorted(LOREM))]).word)
    out = np.zeros(len(texts), bool)
    for n, holds in ((5, known), (4, np.concatenate([hashed.word[1:] == hashed.word[:-1], [False]]) if len(known) else known)):
        run = np.convolve(holds, np.ones(n if n == 5 else 3, int), "valid") == (n if n == 5 else 3) if len(holds) >= n else np.empty(0, bool)
        at = np.flatnonzero(run)
        at = at[at + n <= len(hashed.doc)]
        at = at[hashed.doc[at] == hashed.doc[at + n - 1]]
        for d in set(hashed.doc[at].tolist()):
            out[d] |= n == 5 or bool(STUTTER.search(texts[d]))
    return out


def slot_form(chunk: str) -> str:
    """``name`` for a delimited variable name, ``hint`` for an instruction in brackets, ``blank`` for lines and crosses, ``format`` for a format letter, ``bare`` for one word in brackets, ``word`` for a reminder, ``other`` for anything else."""
    if chunk[0] in "X_" and not any(c.islower() for c in chunk):
        return "blank" if set(chunk) <= set("X_ \t\n") else "name"
    if chunk in ("TODO", "TBD", "FIXME"):
        return "word"
    if chunk.startswith(("TODO", "TBD", "FIXME")):
        return "name"
    if chunk in ("%s", "%d"):
        return "format"
    if "_" in chunk and chunk.isupper():
        return "name"
    inner = chunk[2:-2] if chunk.startswith("%(") else chunk.strip("{}[]<>$#%@()_?=- \t")
    if HINT.match(inner) or inner.isupper() and " " in inner:
        return "hint"
    single = chunk[0] in "[<" and chunk[1] not in "[<%?"
    if NAME.fullmatch(inner):
        return "name" if not single or "_" in inner or "." in inner or inner.lower() in NAMES else "bare"
    return "other"


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def slots(text: str) -> list[tuple[str, str, int, str, str]]:
    """(chunk, form, place, left window, right window) of all chunks written like slots.

    A window holds the words before and after the chunk as they stand side by side
    in a record without it: two before and one after, or one before and two after.
    """
    if not _MARKS.search(text):
        return []
    found = [m for m in SLOT.finditer(text) if m.group() not in SPEAKER]
    if not found:
        return []
    # neighbours of neighbouring chunks are looked for beyond them
    plain = SLOT.sub(lambda m: m.group() if m.group() in SPEAKER else " ", text)
    shift, out = 0, []
    for m in found:
        at = m.start() - shift
        shift += len(m.group()) - 1
        before = re.findall(r"[^\W_]+", _DIGITS.sub("0", plain[max(0, at - 120) : at]).lower())[-2:]
        after = re.findall(r"[^\W_]+", _DIGITS.sub("0", plain[at : at + 120]).lower())[:2]
        left = " ".join([*before, after[0]]) if len(before) == 2 and after else ""
        right = " ".join([before[-1], *after]) if before and len(after) == 2 else ""
        out.append((_DIGITS.sub("#", m.group()), slot_form(m.group()), _hash(f"{before[-1] if before else ''} {after[0] if after else ''}"), left, right))
    return out


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str]]]:
    """(src, text) of texts that the task has not seen, some at a time."""
    seen: set[int] = set()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            fresh = []
            for src, text in zip(batch.column("src").to_pylist(), batch.column("text").to_pylist()):
                if src not in seen:
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(src)
                    fresh.append((src, text))
            if fresh:
                yield fresh


def _signals(texts: DataFrame) -> DataFrame:
    """(src, kind, key, place, a, b, form): slots, and the segments of texts with page wording or filler; ``src`` tells distinct texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, str]] = {}
        stems = _stems().iter
        for fresh in _fresh(batches):
            rows: list[tuple] = []
            sides: list[str] = []
            for (src, text), filler in zip(fresh, filler_runs([t for _, t in fresh])):
                for chunk, form, place, left, right in slots(text):
                    rows.append((src, "slot", chunk, place, left, right, form))
                    sides += [left, right]
                if filler:
                    rows.append((src, "strong", "", 0, "", "", "filler"))
                if next(stems(text.lower()), None) is None:
                    continue
                own, page = [], False
                for s in segments(text):
                    if s not in known:
                        if len(known) >= 1 << 16:
                            known.clear()
                        known[s] = wording(s)
                    strong, weak = known[s]
                    page |= bool(strong) or weak.endswith("message")
                    if strong:
                        rows.append((src, "strong", "", 0, "", "", strong))
                    own.append((src, "segment", "", _hash(s), "", "", weak))
                rows += own if page else [r for r in own if r[6]]
            sides = sorted(set(sides) - {""})
            of, h = hash_words(sides).all_shingles(3)
            window = {sides[k]: x for k, x in zip(of[::-1].tolist(), h[::-1].astype(np.int64).tolist())}
            rows = [(*r[:4], window.get(r[4], 0), window.get(r[5], 0), r[6]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_SIGNAL_TYPES)], _SIGNAL_NAMES)

    return texts.mapInArrow(run, "src long, kind string, key string, place long, a long, b long, form string")


_SIGNAL_NAMES = ["src", "kind", "key", "place", "a", "b", "form"]
_SIGNAL_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _bits(h: np.ndarray) -> np.ndarray:
    return (mix(h.astype(np.int64).view(np.uint64)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _wanted(signals: DataFrame) -> np.ndarray:
    """A table of fixed size with a bit for each window and segment that is to be looked for."""
    ranges = 16
    each = (1 << TABLE_BITS) // 8 // ranges

    def mark(batches):
        table = np.zeros(1 << TABLE_BITS, bool)
        for batch in batches:
            for c in ("a", "b", "place"):
                h = batch.column(c).to_numpy()
                table[_bits(h[h != 0] if c != "place" else h[np.array(batch.column("kind").to_pylist()) == "segment"])] = True
        packed = np.packbits(table)
        yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([packed[i * each : (i + 1) * each].tobytes() for i in range(ranges)], pa.binary())], ["r", "bits"])

    def join(t: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in t.column("bits").to_pylist()])
        return pa.table({"r": t.column("r").slice(0, 1), "bits": pa.array([both.tobytes()], pa.binary())})

    out = np.zeros((ranges, each), np.uint8)
    for row in signals.select("kind", "a", "b", "place").mapInArrow(mark, "r int, bits binary").groupBy("r").applyInArrow(join, "r int, bits binary").toLocalIterator():  # 16 rows, 2 MB
        out[row.r] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def _occurrences(texts: DataFrame, wanted) -> DataFrame:
    """(src, h): the windows and segments of all texts that the table has a bit for; of a window each task gives ALIGNED texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(wanted.value).view(bool)
        met: dict[int, int] = {}  # texts of this task with a window; ALIGNED of them are enough
        for fresh in _fresh(batches):
            src = np.array([s for s, _ in fresh], np.int64)
            doc, h = hash_words([_DIGITS.sub("0", t) for _, t in fresh]).shingles(3)
            h = h.astype(np.int64)
            hit = np.flatnonzero(table[_bits(h)])
            if len(met) > 1 << 20:
                met.clear()
            out_src, out = [], []
            for x, d in zip(h[hit].tolist(), doc[hit].tolist()):
                n = met.get(x, 0)
                if n < ALIGNED:
                    met[x] = n + 1
                    out.append(x)
                    out_src.append(d)
            own = [(k, _hash(s)) for k, (_, t) in enumerate(fresh) for s in set(segments(t))]
            line_of, line = (np.array([x[k] for x in own], np.int64) for k in (0, 1))
            there = table[_bits(line)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([src[np.array(out_src, np.int64)], src[line_of[there]]])), pa.array(np.concatenate([np.array(out, np.int64), line[there]]))], ["src", "h"])

    return texts.mapInArrow(run, "src long, h long")


def find_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, kind): documents with residue and its kinds: slot_aligned, slot_default, placeholder, page_template, filler, error_page, script_notice.

    The last three are decided by strong wording alone, ``placeholder`` by the form
    of a chunk whose template no other text has; the others by alignment and
    recurrence. NULL and empty texts have none; repeated rows and texts count once;
    texts are read whole, and all counts are over all documents. A table without
    rows gives none.
    """
    spark = df.sparkSession
    source = df.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL AND text <> ''").withColumn("src", F.xxhash64("text"))
    texts = source.select("src", "text")
    signals = stored(_signals(texts), "residue")
    wanted = spark.sparkContext.broadcast(_wanted(signals))
    there = stored(_occurrences(texts, wanted), "occurrences")
    seen = stored(there.groupBy("h").agg(F.count_distinct("src").alias("texts")).where(f"texts >= {min(ALIGNED, RECURS)}"), "recurring")

    slot = signals.where("kind = 'slot'").drop("kind")
    met = slot.select(F.explode(F.array("a", "b")).alias("h")).where("h <> 0").distinct().join(seen.where(f"texts >= {ALIGNED}").select("h"), "h", "left_semi")
    a, b = (met.select(F.col("h").alias(c), F.lit(True).alias(f"has_{c}")) for c in ("a", "b"))
    slot = slot.join(a, "a", "left").join(b, "b", "left").withColumn("aligned", F.coalesce("has_a", "has_b", F.lit(False)))
    places = slot.groupBy("key", "place").agg(F.count_distinct("src").alias("texts"), F.max("aligned").alias("met"))
    chunks = places.groupBy("key").agg(F.count("*").alias("places"), F.max("texts").alias("most"), F.sum("texts").alias("all"), F.count_if("met").alias("met_places"))
    default = chunks.select("key", (F.col("met_places") >= ALIGNED).alias("met_elsewhere"), ((F.col("places") >= PLACES) & (F.col("most") <= ONE_PLACE * F.col("all")) & (2 * F.col("met_places") >= F.col("places"))).alias("default"))
    fixed = places.select("key", "place", (~F.col("met") & (F.col("texts") >= RECURS)).alias("fixed"))
    judged = slot.join(default, "key").join(fixed, ["key", "place"])
    named = F.col("form").isin("name", "hint", "blank", "format")
    kind = (
        F.when(F.col("aligned") & (named | F.col("form").isin("word", "bare")), "slot_aligned")
        .when(F.col("default") | (F.col("met_elsewhere") & (F.col("form") == "bare") & ~F.col("fixed")), "slot_default")
        .when(named & (~F.col("fixed") | (F.col("form") == "format")), "placeholder")
    )
    found = judged.select("src", kind.alias("kind")).where("kind IS NOT NULL")

    strong = signals.where("kind = 'strong'").select("src", F.col("form").alias("kind"))
    segment = signals.where("kind = 'segment'").select("src", F.col("place").alias("h"), "form").distinct()
    message = F.endswith(F.col("form"), F.lit("message"))
    several = segment.where("form <> ''").groupBy("src").agg(F.count("*").alias("n"), F.count_if(message).alias("messages"), F.max(F.when(message, F.split_part("form", F.lit(" "), F.lit(1)))).alias("kind"))
    messages = several.where("messages > 0 AND n > 1").select("src", "kind")
    recurring = segment.join(seen.where(f"texts >= {RECURS}"), "h")
    sure = strong.unionByName(messages).select("src").distinct().withColumn("sure", F.lit(True))
    # what nearly only pages with other residue hold is of their template; weak wording asks for half of that, a message for none
    share = recurring.join(sure, "src", "left").groupBy("h", "form", "texts").agg(F.count("sure").alias("on_pages"))
    least = F.when(message, 0.0).when(F.col("form") != "", ON_PAGES / 2).otherwise(ON_PAGES)
    pages = there.join(share.where(F.col("on_pages") >= least * F.col("texts")).select("h"), "h", "left_semi").select("src", F.lit("page_template").alias("kind"))
    strong = strong.unionByName(messages)
    kinds = found.unionByName(strong).unionByName(pages).distinct()
    return source.select("doc", "src").join(kinds, "src").select("doc", "kind").distinct()
