"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame and SQL functions only. Matches of a pattern are the gaps of ``split`` by the same pattern,
so their places follow from the lengths of the pieces; places are in code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import text_of, unused


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` is a Java regular expression, ``valid`` an SQL condition on ``x`` (the match), ``score``
    what a valid match gets, ``context`` words (alternatives of a pattern) that add ``bonus`` if one
    stands within ``window`` characters before or after, ``least`` the score a span needs to be reported.
    """

    name: str
    pattern: str
    valid: str
    score: float
    context: str
    bonus: float = 0.1
    least: float = 0.5


def _luhn(digits: str) -> str:
    """Luhn's check over the digit string ``digits``: from the right, every second digit is doubled."""
    return (
        f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + "
        f"(case when i % 2 = 1 then int(substr({digits}, length({digits}) - i + 1, 1)) "
        f"else int(substr('0246813579', int(substr({digits}, length({digits}) - i + 1, 1)) + 1, 1)) end)) % 10 = 0"
    )


def _mod97(iban: str) -> str:
    """ISO 7064 mod 97-10: the first four characters go to the end, letters count 10 to 35."""
    moved = f"concat(substr({iban}, 5), substr({iban}, 1, 4))"
    value = "locate(c, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ') - 1"
    return f"aggregate(split({moved}, ''), 0, (s, c) -> case when c = '' then s when {value} < 10 then (s * 10 + {value}) % 97 else (s * 100 + {value}) % 97 end) = 1"


_CARD = "regexp_replace(x, '[^0-9]', '')"
_IBAN = "replace(x, ' ', '')"

#: The base kinds of the contract, in its order. Starts are anchored where a run of the pattern's first
#: characters begins (or where the last match ended) and repeats are possessive: same matches, linear time.
BASE = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
        0.9,
        "mail|contact|write|adres|kontakt|correo",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        "forall(split(x, '[.]'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', right(ltrim('0', p), 3))) <= 255)",
        0.8,
        "ip|host|server|address|login",
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", f"length({_CARD}) between 12 and 19 and {_luhn(_CARD)}", 0.8, "card|visa|credit|karte|carte|tarjeta|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_CARD}) between 9 and 15", 0.7, "phone|call|tel|mobile|fax"),
)

#: What the method adds: account numbers confirmed by mod 97, and social security numbers and long
#: hexadecimal secrets that count only beside a context word.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", f"length({_IBAN}) between 15 and 34 and {_mod97(_IBAN)}", 0.8, "iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "substr(x, 1, 3) not in ('000', '666') and substr(x, 1, 1) <> '9' and substr(x, 5, 2) <> '00' and substr(x, 8, 4) <> '0000'", 0.3, "ssn|social security|tax id", 0.4),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}+(?![A-Za-z0-9])", "x rlike '[0-9]' and x rlike '[A-Fa-f]'", 0.3, "token|secret|password|passwd|api.?key|credential", 0.4),
)


#: Matches are worked on in blocks of this many, so that appending to arrays stays cheap.
BLOCK = 128


def _spans(kind: Kind, order: int, window: int, text: str) -> str:
    """SQL for the valid spans of one kind in the column ``text``.

    The pieces between matches give their places: first the start of each block of matches, then the matches' in it.
    A block's surroundings are cut out of the text once, for its matches' context.
    """
    found = f"regexp_extract_all({text}, r'{kind.pattern}', 0)"
    pieces = f"split({text}, r'{kind.pattern}', -1)"
    matches = f"transform(array({found}), f -> zip_with(slice({pieces}, 1, size(f)), f, (p, x) -> named_struct('gap', length(p), 'len', length(x), 'x', x)))[0]"
    empty = "cast(array() as array<struct<start:int,rank:int,kind:string,end:int,text:string,score:double>>)"
    start = "(a.at + y.gap)"
    local = f"({start} - b.base)"
    near = f"lower(concat(substr(b.around, greatest(1, {local} + 1 - {window}), least({window}, {local})), ' ', substr(b.around, {local} + y.len + 1, {window})))"
    score = f"{kind.score}D + case when {near} rlike '{kind.context}' then {kind.bonus}D else 0D end"
    valid = f"exists(array(y.x), x -> {kind.valid})"
    entry = f"named_struct('start', {start}, 'rank', {order}, 'kind', '{kind.name}', 'end', {start} + y.len, 'text', y.x, 'score', {score})"
    of_block = (
        f"aggregate(b.m, named_struct('at', b.at, 'out', {empty}), "
        f"(a, y) -> named_struct('at', a.at + y.gap + y.len, 'out', case when {valid} then concat(a.out, array({entry})) else a.out end), a -> a.out)"
    )
    blocks = f"transform(sequence(0, cast((size(m) - 1) / {BLOCK} as int)), k -> slice(m, k * {BLOCK} + 1, {BLOCK}))"
    starts = "aggregate(c, array(0), (s, k) -> concat(s, array(element_at(s, -1) + aggregate(k, 0, (n, y) -> n + y.gap + y.len))))"
    base = f"greatest(0, s[i] - {window})"
    placed = f"transform(c, (k, i) -> named_struct('m', k, 'at', s[i], 'base', {base}, 'around', substr({text}, {base} + 1, s[i + 1] - {base} + {window})))"
    whole = f"transform(array({blocks}), c -> transform(array({starts}), s -> flatten(transform({placed}, b -> {of_block})))[0])[0]"
    return f"transform(array({matches}), m -> case when size(m) = 0 then {empty} else {whole} end)[0]"


def find_pii(df: DataFrame, text_col: str = "text", spans_col: str = "spans", kinds: tuple[Kind, ...] = BASE + ADDED, window: int = 40) -> DataFrame:
    """Add ``spans``: array of (start, rank, kind, end, text, score), ordered by start, then kind.

    ``rank`` is the kind's place in ``kinds``. Nulls: a null text counts as empty and has no spans.
    Very long texts are read whole. Repeated rows get the same spans. An empty table gives no rows. Extra columns
    pass through, whatever their names; one named like ``spans_col`` is replaced.
    """
    text, *places = unused(df, "text", *[f"kind{i}" for i in range(len(kinds))])
    out = df.withColumn(text, text_of(text_col))
    for i, kind in enumerate(kinds):
        out = out.withColumn(places[i], F.expr(f"filter({_spans(kind, i, window, text)}, s -> s.score >= {kind.least}D)"))
    found = F.array_sort(F.flatten(F.array(*[F.col(c) for c in places])))
    return out.withColumn(spans_col, found).drop(text, *places)
