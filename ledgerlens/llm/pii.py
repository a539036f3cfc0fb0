"""Personal data in whole texts, disguised or not, with offsets into the original text.

Four kinds of identifier are looked for in the text as it is: these are the *base* spans. Then
two transducers rewrite the text. The first folds look-alike letters and digits of other alphabets
and drops invisible characters; the second turns spelled digits into digits and ``at`` and ``dot``
disguises into ``@`` and ``.``. Both keep, for every character they write, the source
characters it stands for. The same identifiers are looked for in the rewritten text and
each find is mapped back; it is added unless a base span of its kind covers it.

Spans are code points, end exclusive. Null text counts as empty and has none. Each input row
gives one output row, so repeated rows and null or repeated ids stay; columns other than id and
text are not carried along.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
from collections.abc import Callable, Iterator
from operator import and_
from typing import NamedTuple

from pyspark.sql import DataFrame

from ledgerlens.llm.rows import map_rows

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digit runs are taken whole: a match can neither start nor end inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_HAS_DIGIT, _HAS_DOTTED = re.compile("[0-9]"), re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LUHN_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _emails(text: str) -> Iterator[Span]:
    """Addresses, found from each ``@`` outwards so that long words cost their length only."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_END:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield Span("email", start, free)
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    from_right = [int(d) for d in reversed(digits)]
    return (sum(from_right[::2]) + sum(_LUHN_DOUBLED[d] for d in from_right[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Identifiers as they stand, by kind and then by start."""
    found = list(_emails(text))
    if not _HAS_DIGIT.search(text):
        return found
    for m in _IP.finditer(text) if _HAS_DOTTED.search(text) else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(Span("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(Span("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append(Span("phone", *m.span()))
    return found


#: Letters of other alphabets and the Latin letters and digits they look like, by alphabet: Cyrillic,
#: Greek, Armenian, Cherokee, phonetic and other Latin (fixed values).
LOOK_ALIKES = {
    letter: plain
    for letters, plains in (
        (
            "ЅІЈАВЕКМНОРСТУХабвгдезкмнопрстухѕіјһӏԁԛԝѵҮү",
            "SIJABEKMHOPCTYXa6brde3kmhonpctyxsijhldqwvYy",
        ),
        ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγεικνορτυχωϲϳ", "ABEZHIKMNOPTYXayeiknoptuxwcj"),
        ("ԼՕՍՏազգցհյոսօ", "LOUSwqqghjnuo"),
        ("ᎠᎢᎪᎫᎬᎳᎶᎷᎻᏀᏃᏆᏒᏚᏞᏟᏢᏦᏴ", "DTAJEWGMHGZTRSLCPKB"),
        ("ıȷɑɡɩɪʋ", "ijagiiu"),
    )
    for letter, plain in zip(letters, plains, strict=True)
}
#: Letters of which there is a small capital form (fixed values).
SMALL_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWYZ"
#: Characters that show nothing (fixed values).
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Dashes, spaces and full stops that stand for the plain ones (fixed values).
PLAIN_SIGNS = (
    dict.fromkeys("\u2010\u2011\u2012\u2013\u2212", "-")
    | dict.fromkeys("\u00a0\u2007\u2009\u202f", " ")
    | dict.fromkeys("\u2024\u3002\uff61", ".")
)


@functools.cache
def folding() -> dict[int, str]:
    """Code point to its plain form: the tables above, and compatibility forms and digits by rule."""
    folds = {ord(c): plain for c, plain in {**LOOK_ALIKES, **PLAIN_SIGNS}.items()}
    blocks = (
        range(0x1D00, 0x1D80),
        range(0x660, 0xE00),
        range(0x2070, 0x2500),
        range(0xFE50, 0xFE70),
        range(0xFF01, 0xFF5F),
        range(0x1D400, 0x1D800),
    )
    for block in blocks:
        folds |= {code: plain for code in block if (plain := _plain(chr(code)))}
    small = {unicodedata.lookup(f"LATIN LETTER SMALL CAPITAL {c}"): c.lower() for c in SMALL_CAPITALS}
    return folds | {ord(c): plain for c, plain in small.items()}


@functools.cache
def _foreign() -> frozenset[str]:
    return frozenset(map(chr, folding()))


def _plain(c: str) -> str:
    """The one ASCII character that ``c`` is a form of, or nothing."""
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    form = unicodedata.normalize("NFKC", c)
    return form if len(form) == 1 and form.isascii() and form != c else ""


#: Spelled digits in four languages (fixed values).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
#: Words that say how often the digit after them stands (fixed values).
TIMES = {"double": 2, "triple": 3}
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ONE = rf"(?:(?:{'|'.join(TIMES)})[ \t]{{1,3}})?(?:{_DIGIT}|(?<![0-9])[0-9])"
_POINT = r"[ \t]{1,3}(?:dot|punto|punkt|point)[ \t]{1,3}"
_GAP = rf"(?:{_POINT}|[ \t]{{1,3}}|[ \t]{{0,3}}[-,.][ \t]{{0,3}})"
# A spelled number: four digit words or more, among which may stand plain digits.
_SPELLED = re.compile(
    rf"(?<!\w)(?:(?P<plus>plus)[ \t]{{1,3}})?{_ONE}(?:{_GAP}{_ONE}){{3,}}(?!\w)",
    re.IGNORECASE,
)
_SPELLED_PART = re.compile(
    rf"(?<!\w)(?:(?P<times>{'|'.join(TIMES)})[ \t]+)?(?P<digit>{_DIGIT}|[0-9])", re.IGNORECASE
)
# Any row of digit words and numbers; it counts where a word touches a number of several figures
# or a plus sign. A full stop with white space is prose here.
_PIECE = rf"(?:(?:(?:{'|'.join(TIMES)})[ \t]{{1,3}})?(?:{_DIGIT})|[0-9]++)(?!\w)"
_ROW_GAP = rf"(?:{_POINT}|[ \t]{{1,3}}|[ \t]{{0,3}}-[ \t]{{0,3}}|\.)"
_ROW = re.compile(
    rf"(?<!\w)(?:(?P<plus>plus[ \t]{{1,3}}|\+[ \t]{{0,3}}))?{_PIECE}(?:{_ROW_GAP}{_PIECE})*+",
    re.IGNORECASE,
)
_ROW_PART = re.compile(
    rf"(?<!\w)(?:(?P<times>{'|'.join(TIMES)})[ \t]+)?(?P<digit>{_DIGIT}|[0-9]+)(?!\w)", re.IGNORECASE
)
_SPELLED_POINT = re.compile(rf"\.|{_POINT}", re.IGNORECASE)
# Letters that look like digits, in a word of those and digits.
_MIXED_HINT = re.compile("[0-9](?:(?<=[OoIl][0-9])|(?=[OoIl]))")
_MIXED = re.compile(r"(?<!\w)(?=[OoIl]*+[0-9])[0-9OoIl]++(?!\w)")
_DIGIT_LOOKS = str.maketrans("OoIl", "0011")
# Quick tests on the lower-case text, so that plain prose costs one pass or less.
_DIGIT_TOKENS = frozenset({*DIGIT_WORDS, *DIGIT_WORDS.values()})
_MARKS = ("[", "(", "{", "<", "&#", "&c", "&p", "%4", "%2")
_SPOKEN = ("dot", "punto", "punkt", "arroba", " @", "\t@", "@ ", "@\t")
# Bracketed disguises stand on their own; bare words only as "name at host dot com", since
# "met at the dot on the map" is prose. After a plain dot these endings count (fixed values), after
# a spoken one also those of two letters and the longer ones below, and any behind "arroba",
# which is no English word:
_ENDINGS = frozenset(
    "com org net edu gov mil info biz io dev app co de fr es uk eu ch nl se ca au in jp br mx".split()
)
_LONG_ENDINGS = frozenset(
    "academy aero agency asia bank berlin blog cat center chat cloud club coop corp design digital "
    "email energy example expert finance fun global gmbh group guru health help home host hotel "
    "house int international invalid jobs lan land law legal life link live llc local london "
    "marketing media mobi museum name network news ninja one online page paris partners post press "
    "pro rocks school science services shop site software solutions space store studio support "
    "systems team tech tel test today tools top tours trade travel university website wiki win "
    "work works world xyz zone".split()
)
# Words before which "at" is no sign, and words that are no name before a spoken one (fixed values).
_NO_HOSTS = frozenset("the a an this that our my your his her their".split())
_NO_NAMES = frozenset("i me you he him she her it we us they them be is are was were".split())
_DOT_NAMES = "dot|punto|punkt|point"
_BRACKETED = re.compile(
    rf"[\[({{<][ \t]{{0,3}}(?:(?P<at>at|arroba|chez|@)|(?P<dot>{_DOT_NAMES}|\.))"
    r"[ \t]{0,3}[\])}>][ \t]{0,3}|(?P<at2>&#64;|&#x40;|&commat;|%40)"
    r"|(?P<dot2>&#46;|&#x2e;|&period;|%2E)",
    re.IGNORECASE,
)
# A bare "at" counts if the dot after it is bracketed.
_HALF_BRACKETED = re.compile(
    r"(?<=[A-Za-z0-9._%+-])[ \t]{1,3}(?:at|arroba)[ \t]{1,3}"
    rf"(?=[A-Za-z0-9-]++[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}(?:{_DOT_NAMES}|\.)[ \t]{{0,3}}[\])}}>])",
    re.IGNORECASE,
)
_EDGE = r"(?:[ \t]{0,3}[-_*~][ \t]{0,3}|[ \t]{1,3})"
_SPOKEN_AT = re.compile(
    rf"{_EDGE}(?P<word>at|arroba){_EDGE}|[ \t]{{0,3}}@[ \t]{{0,3}}", re.IGNORECASE
)
_SPOKEN_DOT = re.compile(
    rf"{_EDGE}(?P<word>dot|punto|punkt){_EDGE}|[ \t]{{1,3}}\.[ \t]{{0,3}}|\.", re.IGNORECASE
)
_LABEL = re.compile(
    r"[A-Za-z0-9]++(?:-(?!(?:dot|punto|punkt|at|arroba)-)[A-Za-z0-9]++)*+", re.IGNORECASE
)
_ANY_ENDING = re.compile("[A-Za-z]{2,}|xn--[A-Za-z0-9-]+")
_SHORT_ENDING = re.compile("[A-Za-z]{2}|xn--[A-Za-z0-9-]+")
# "name(a)host.com", only with a host behind it and nothing between.
_BRACKETED_A = re.compile(
    r"(?<=[A-Za-z0-9._%+-])(?:\(a\)|\[a\]|\{a\})(?P<host>(?:[A-Za-z0-9-]++(?:\.(?=[A-Za-z0-9]))?+)++)",
    re.IGNORECASE,
)
_NAME_DOT = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,3}(?:dot|punto|punkt)[ \t]{1,3}\Z", re.IGNORECASE)
# Four numbers with "dot" between some of them.
_NUMBERS = re.compile(
    r"(?<![\w.])[0-9]{1,3}(?:(?:[ \t]{1,3}(?:dot|punto|punkt)[ \t]{1,3}|\.)[0-9]{1,3}){3}(?!\w)",
    re.IGNORECASE,
)


class Rewritten:
    """A text and, for every character of it, the source characters it was written for."""

    def __init__(self, text: str):
        self.text = text
        self.sources: list[tuple[int, int]] | None = None

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply disjoint edits in order; written characters share the replaced stretch."""
        if not edits:
            return
        old = self.sources or [(i, i + 1) for i in range(len(self.text))]
        pieces, sources, done = [], [], 0
        for start, end, put in edits:
            pieces += [self.text[done:start], put]
            sources += old[done:start]
            if put:
                stretch = (old[start][0], old[end - 1][1])
                sources += [stretch] * len(put)
            done = end
        self.text = "".join([*pieces, self.text[done:]])
        self.sources = sources + old[done:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        if self.sources is None:
            return start, end
        return self.sources[start][0], self.sources[end - 1][1]


_INVISIBLE = re.compile(f"[{INVISIBLE}]+")


Edit = tuple[int, int, str]


def _spelled_edits(text: str) -> Iterator[Edit]:
    for m in _SPELLED.finditer(text):
        if m["plus"]:
            yield m.start("plus"), m.end("plus"), "+"
        parts = list(_SPELLED_PART.finditer(text, m.end("plus") if m["plus"] else m.start(), m.end()))
        for before, part in zip([None, *parts], parts):
            start = before.end() if before else (m.end("plus") if m["plus"] else part.start())
            point = "." if _SPELLED_POINT.search(text, start, part.start()) else ""
            digit = DIGIT_WORDS.get(part["digit"].lower(), part["digit"])
            yield start, part.end(), point + digit * TIMES.get((part["times"] or "").lower(), 1)


def _row_edits(text: str) -> Iterator[Edit]:
    """Digit words that stand next to a number of several figures or behind a plus sign."""
    for m in _ROW.finditer(text):
        at = m.end("plus") if m["plus"] else m.start()
        parts = list(_ROW_PART.finditer(text, at, m.end()))
        spelled = [not part["digit"].isdecimal() for part in parts]
        long = any(len(part["digit"]) > 1 for part, word in zip(parts, spelled) if not word)
        if not any(spelled) or not (m["plus"] or long):
            continue
        # A lone word behind a whole identifier is prose: "+49 30 1234567 one of us".
        if sum(spelled) == 1 and spelled[-1] and len(parts) > 1:
            if base_spans(text[m.start() : parts[-2].end()]):
                continue
        if m["plus"] and m["plus"] != "+":
            yield m.start("plus"), at, "+"
        for i, (part, word) in enumerate(zip(parts, spelled)):
            start = parts[i - 1].end() if i else part.start()
            if not word and (i == 0 or not spelled[i - 1]):  # plain numbers keep what parts them
                continue
            point = "." if _SPELLED_POINT.search(text, start, part.start()) else ""
            digit = DIGIT_WORDS.get(part["digit"].lower(), part["digit"])
            yield start, part.end(), point + digit * TIMES.get((part["times"] or "").lower(), 1)


def _mixed_edits(text: str) -> Iterator[Edit]:
    for m in _MIXED.finditer(text):
        digits = m[0].translate(_DIGIT_LOOKS)
        for i, (letter, digit) in enumerate(zip(m[0], digits), m.start()):
            if letter != digit:
                yield i, i + 1, digit


def _bracketed_a_edits(text: str) -> Iterator[Edit]:
    for m in _BRACKETED_A.finditer(text):
        name, _, ending = m["host"].rpartition(".")
        if name and ending.lower() in _ENDINGS:
            yield m.start(), m.start("host"), "@"


def _bracket_edits(text: str) -> Iterator[Edit]:
    done = 0
    for m in _BRACKETED.finditer(text):
        start = m.start()
        while start > max(done, m.start() - 3) and text[start - 1] in " \t":
            start -= 1
        done = m.end()
        yield start, done, "@" if m["at"] or m["at2"] else "."


def _ends_host(label: str, spoken: bool, after_arroba: bool) -> bool:
    """Whether a host may end in the label behind a dot that is spoken, or plain after "arroba"."""
    if label in _ENDINGS:
        return True
    if label in _NO_HOSTS or not (spoken or after_arroba):
        return False
    if after_arroba:
        return bool(_ANY_ENDING.fullmatch(label))
    return label in _LONG_ENDINGS or bool(_SHORT_ENDING.fullmatch(label))


def _spoken_host(text: str, at: re.Match) -> list[re.Match]:
    """The dots of the host that stands behind a spoken ``at``; none if there is no host."""
    dots, good = [], 0
    arroba = (at["word"] or "").lower() == "arroba"
    label = _LABEL.match(text, at.end())
    if not label or at["word"] and label[0].lower() in _NO_HOSTS:
        return []
    while label:
        if dots and text[label.end() : label.end() + 1] not in ("-", "_"):
            if _ends_host(label[0].lower(), bool(dots[-1]["word"]), arroba and dots[-1][0] == "."):
                good = len(dots)
        if dot := _SPOKEN_DOT.match(text, label.end()):
            dots.append(dot)
        label = dot and _LABEL.match(text, dot.end())
    dots = dots[:good]
    return dots if not at["word"] or arroba or any(dot["word"] for dot in dots) else []


def _spoken_edits(text: str) -> Iterator[Edit]:
    """Edits of ``name at host dot com`` and the like."""
    done = 0
    for at in _SPOKEN_AT.finditer(text):
        if at.start() <= done or not (dots := _spoken_host(text, at)):
            continue
        name, start = [], at.start()
        while True:
            end = start
            while start > done and text[start - 1] in _LOCAL_END:
                start -= 1
            dot = start < end and _NAME_DOT.search(text, max(done, start - 16), start)
            if not dot:
                break
            name.append((*dot.span(), "."))
            start = dot.start()
        if at["word"] and at[0][0] in " \t" and text[start : at.start()].lower() in _NO_NAMES:
            continue
        if at.start() > 0 and text[at.start() - 1] in _LOCAL_END:
            yield from reversed(name)
            yield *at.span(), "@"
            yield from ((*dot.span(), ".") for dot in dots)
            done = dots[-1].end()


def _number_edits(text: str) -> Iterator[Edit]:
    for m in _NUMBERS.finditer(text):
        for dot in _SPOKEN_DOT.finditer(text, m.start(), m.end()):
            yield *dot.span(), "."


_BESIDE_NUMBER = re.compile(
    rf"(?:[0-9]{{2}}|\+[0-9]?){_ROW_GAP}?(?:{'|'.join(TIMES)}|{_DIGIT})(?!\w)"
    rf"|(?<!\w)(?:{_DIGIT}){_ROW_GAP}[0-9]{{2}}|(?<!\w)plus[ \t]{{1,3}}(?:{'|'.join(TIMES)}|{_DIGIT}|[0-9])"
)


def _may_spell(lower: str) -> bool:
    """Whether two digit words or digits stand side by side, as in every longer row of them."""
    tokens = lower.replace("-", " ").replace(",", " ").replace(".", " ").split()
    if _DIGIT_TOKENS.isdisjoint(tokens):
        return False
    digits = list(map(_DIGIT_TOKENS.__contains__, tokens))
    return any(map(and_, digits, digits[1:]))


def normalised(text: str) -> Rewritten:
    """The text with look-alikes, spelled digits and disguises undone."""
    out = Rewritten(text)
    if not text.isascii() and not _foreign().isdisjoint(text):
        out.text = text.translate(folding())  # one character for one: offsets stay
    if any(c in text for c in INVISIBLE):
        out.replace([(*m.span(), "") for m in _INVISIBLE.finditer(out.text)])
    if any(mark in out.text for mark in _MARKS):
        out.replace([(*m.span(), "@") for m in _HALF_BRACKETED.finditer(out.text)])
        out.replace(list(_bracketed_a_edits(out.text)))
        out.replace(list(_bracket_edits(out.text)))
    lower = out.text.lower()
    if _may_spell(lower):
        out.replace(list(_spelled_edits(out.text)))
    if _BESIDE_NUMBER.search(lower):
        out.replace(list(_row_edits(out.text)))
    if any(word in lower for word in _SPOKEN):
        out.replace(list(_spoken_edits(out.text)))
        out.replace(list(_number_edits(out.text)))
    if _MIXED_HINT.search(out.text):
        out.replace(list(_mixed_edits(out.text)))
    return out


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and those added by undoing disguises; both by kind, then start."""
    text = text or ""
    base = base_spans(text)
    plain = normalised(text)
    if plain.text == text:
        return base, []
    own: dict[str, list[Span]] = {kind: [s for s in base if s.kind == kind] for kind in KINDS}
    starts = {kind: [s.start for s in spans] for kind, spans in own.items()}
    added = set()
    for found in base_spans(plain.text):
        span = Span(found.kind, *plain.source(found.start, found.end))
        # Base spans of a kind do not overlap: the first that starts no earlier, and the one before it.
        first = bisect.bisect_left(starts[span.kind], span.start)
        near = own[span.kind][max(first - 1, 0) : first + 1]
        if not any(s.start <= span.start and s.end >= span.end for s in near):
            if not any(_lengthened(text, s, span) for s in near):
                added.add(span)
    return base, sorted(added, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


_LONE_WORD = re.compile(rf"(?:{_ROW_GAP})?(?:{_DIGIT})(?:{_ROW_GAP})?", re.IGNORECASE)


def _lengthened(text: str, base: Span, span: Span) -> bool:
    """Whether ``span`` is a whole number with one digit word before or behind it, which is prose."""
    before, behind = text[span.start : base.start], text[base.end : span.end]
    if span.kind == "email" or span.start > base.start or span.end < base.end:
        return False
    return not (before and behind) and bool(_LONE_WORD.fullmatch(before or behind))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): every span as (kind, start, end, disguised), by kind and start."""
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    span = "struct<kind:string,start:int,end:int,disguised:boolean>"

    def start() -> Callable[..., tuple]:
        def spans(key, text):
            base, added = find_spans(text)
            both = [(s, False) for s in base] + [(s, True) for s in added]
            both.sort(key=lambda x: (KINDS.index(x[0].kind), x[0].start, x[0].end))
            names = ("kind", "start", "end", "disguised")
            return key, [dict(zip(names, (*s, hidden))) for s, hidden in both]

        return spans

    return map_rows(rows, f"`{id_col}` {id_type}, spans array<{span}>", start)
