"""Column expressions over code and text: matches with their places, literals and comments, lines."""

from __future__ import annotations

import re
from functools import reduce
from re import _constants, _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH = ("python", "ruby", "perl", "shell", "bash")
TEMPLATE = ("typescript", "javascript")

#: Parts of the lexers. Possessive loops (*+) keep the JVM's matcher off the stack; nothing has to be given back.
_TRIPLE = '"""(?:[^"\\\\]|"{1,2}[^"\\\\]|"{0,2}\\\\[\\s\\S])*+(?:"""|"{0,2}\\z)'
_STRING = '"(?:[^"\\\\\\n]|\\\\[\\s\\S])*+"?'
_LINE = "//[^\\n]*\\n?"
_BLOCK = "/\\*(?:[^*]|\\*+[^*/])*+(?:\\*+/|\\**\\z)"
_QUOTED = [_TRIPLE, _TRIPLE.replace('"', "'"), _STRING, _STRING.replace('"', "'")]
LEXERS = {
    "hash": "|".join([*_QUOTED[:2], "#[^\\n]*\\n?", _LINE, *_QUOTED[2:]]),
    "template": "|".join([*_QUOTED[:2], _LINE, _BLOCK, "`(?:[^`\\\\]|\\\\[\\s\\S])*+`?", *_QUOTED[2:]]),
    "block": "|".join([*_QUOTED[:2], _LINE, _BLOCK, *_QUOTED[2:]]),
}


def lexer(lang: Column, apply) -> Column:
    """apply(pattern) with the lexer of the language: where # comments, where ` quotes, and all others."""
    return F.when(lang.isin(*HASH), apply(LEXERS["hash"])).when(lang.isin(*TEMPLATE), apply(LEXERS["template"])).otherwise(apply(LEXERS["block"]))


#: Matches of a text whose places are summed in one go; a text's matches are summed by blocks, so that time stays in proportion to them.
BLOCK = 256
_PLACE = "struct<at:int,line:int,col:int>"
_PLACED = "array<struct<start:int,end:int,line:int,col:int,match:string>>"


def bound(value: Column, then) -> Column:
    """then(value), with the value worked out once: Spark works an expression out anew wherever it is named, also for each step of a lambda."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def _extent(part: str) -> str:
    """SQL: characters, line ends, and characters behind the last line end of a piece of text."""
    return f"named_struct('n', length({part}), 'k', length({part}) - length(replace({part}, '\\n', '')), 't', length(substring_index({part}, '\\n', -1)))"


def _behind(place: str, n: str, k: str, t: str) -> str:
    """SQL: the place (at, line, col; from 0) behind a piece of text of this extent that begins at `place`."""
    return f"named_struct('at', {place}.at + {n}, 'line', {place}.line + {k}, 'col', if({k} > 0, {t}, {place}.col + {t}))"


def _after(place: str, extent: str) -> str:
    return _behind(place, f"{extent}.n", f"{extent}.k", f"{extent}.t")


def _once(value: str, name: str, then: str) -> str:
    """SQL of bound()."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


_ORIGIN = "named_struct('at', 0, 'line', 0, 'col', 0)"
_PAIRS = f"zip_with(slice(both.parts, 1, size(both.found)), both.found, (p, m) -> named_struct('p', {_extent('p')}, 'm', {_extent('m')}, 'match', m))"  # one part more than matches
# by number, as a slice would go through all pairs each time
_BLOCKS = f"transform(transform(sequence(0, size(pairs) - 1, {BLOCK}), b -> transform(sequence(b, least(b + {BLOCK}, size(pairs)) - 1), i -> get(pairs, i))), block -> named_struct('block', block, 'total', aggregate(block, {_ORIGIN}, (acc, x) -> {_once(_after('acc', 'x.p'), 'start', _after('start', 'x.m'))})))"
_STARTS = f"aggregate(blocks, named_struct('place', {_ORIGIN}, 'out', cast(array() AS array<{_PLACE}>)), (acc, b) -> named_struct('place', {_behind('acc.place', 'b.total.at', 'b.total.line', 'b.total.col')}, 'out', concat(acc.out, array(acc.place))), acc -> acc.out)"
_MATCH = "named_struct('start', start.at, 'end', start.at + x.m.n, 'line', start.line + 1, 'col', start.col + 1, 'match', x.match)"
_INSIDE = _once(_after("acc.place", "x.p"), "start", f"named_struct('place', {_after('start', 'x.m')}, 'out', concat(acc.out, array({_MATCH})))")
_RUNS = f"flatten(zip_with(blocks, {_STARTS}, (b, s) -> aggregate(b.block, named_struct('place', s, 'out', cast(array() AS {_PLACED})), (acc, x) -> {_INSIDE}, acc -> acc.out)))"
_WHOLE = f"both -> if(size(both.found) > 0, {_once(_PAIRS, 'pairs', _once(_BLOCKS, 'blocks', _RUNS))}, cast(array() AS {_PLACED}))"

# the same with lengths alone, for what needs neither lines nor texts
_LENGTHS = "zip_with(slice(both.parts, 1, size(both.found)), both.found, (p, m) -> named_struct('p', length(p), 'm', length(m)))"
_SUMMED = f"transform(transform(sequence(0, size(pairs) - 1, {BLOCK}), b -> transform(sequence(b, least(b + {BLOCK}, size(pairs)) - 1), i -> get(pairs, i))), block -> named_struct('block', block, 'total', aggregate(block, 0, (acc, x) -> acc + x.p + x.m)))"
_FROM = "aggregate(blocks, named_struct('at', 0, 'out', cast(array() AS array<int>)), (acc, b) -> named_struct('at', acc.at + b.total, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"
_SPANNED = "array<struct<start:int,end:int>>"
_SPAN = "named_struct('at', acc.at + x.p + x.m, 'out', concat(acc.out, array(named_struct('start', acc.at + x.p, 'end', acc.at + x.p + x.m))))"
_SPANS = f"flatten(zip_with(blocks, {_FROM}, (b, s) -> aggregate(b.block, named_struct('at', s, 'out', cast(array() AS {_SPANNED})), (acc, x) -> {_SPAN}, acc -> acc.out)))"
_BORDERS = f"both -> if(size(both.found) > 0, {_once(_LENGTHS, 'pairs', _once(_SUMMED, 'blocks', _SPANS))}, cast(array() AS {_SPANNED}))"


def placed(parts: Column, found: Column) -> Column:
    """start, end (code points from 0), line and col (from 1) and text of each match, by the extents of the matches and of what is between: array of structs.

    Running sums within blocks of BLOCK matches begin at the blocks' own sums, so no array grows with a text's matches by more than a block. It is told in SQL, which is one
    expression to put together; each step binds what it is given once, since Spark would work a value out anew wherever an expression names it."""
    both = F.array(F.struct(parts.alias("parts"), found.alias("found")))
    return F.coalesce(F.get(F.call_function("transform", both, F.expr(_WHOLE)), F.lit(0)), F.array().cast(_PLACED))


def matches(text: Column, pattern: Column) -> Column:
    """All matches of a pattern (a column), left to right, with their places. Patterns must not match the empty text."""
    return F.when(F.rlike(text, pattern), placed(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)))).otherwise(F.array().cast(_PLACED))


def _borders(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def find_all(text: Column, pattern: str) -> Column:
    """All matches, left to right: array of (start, end), code points from 0. Patterns must not match the empty text."""
    return _borders(matches(text, F.lit(pattern)))


def skip_spans(code: Column, lang: Column) -> Column:
    """(start, end) of the string literals and comments of the code, in order: by lengths alone, as placed() takes several times as long."""
    found = lexer(lang, lambda p: F.regexp_extract_all(code, F.lit(p), F.lit(0)))
    both = F.array(F.struct(lexer(lang, lambda p: F.split(code, p, -1)).alias("parts"), found.alias("found")))
    return F.coalesce(F.get(F.call_function("transform", both, F.expr(_BORDERS)), F.lit(0)), F.array().cast(_SPANNED))


def masked(code: Column, lang: Column) -> Column:
    """The code with each character of its string literals and comments made a space, but line ends kept: places and lines stay."""
    found = lexer(lang, lambda p: F.regexp_extract_all(code, F.lit(p), F.lit(0)))
    parts = lexer(lang, lambda p: F.split(code, p, -1))
    return F.concat_ws("", F.zip_with(parts, found, lambda p, m: F.concat(p, F.array_join(F.transform(F.split(F.coalesce(m, F.lit("")), "\n"), lambda x: F.repeat(F.lit(" "), F.length(x))), "\n"))))


def in_skip(at: Column, spans: Column) -> Column:
    """Whether a place lies in a literal or comment, after the first character of it: by a binary search among the spans, which are in order and apart."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(23, -1, -1)]), lambda p: p <= F.size(spans))
    before = F.aggregate(steps, F.lit(0), lambda n, p: F.when(F.get(spans, n + p - 1)["start"] < at, n + p).otherwise(n))
    return F.coalesce(F.get(spans, before - 1)["end"] > at, F.lit(False))


#: Letters and the like beyond ASCII.
FOREIGN = r"[^\x00-\x7F\pP\pS\pZ\pM]"


def plain(text: Column) -> Column:
    """text with letters beyond ASCII made underscores, so that word borders are the same to every regex engine."""
    return F.regexp_replace(text, FOREIGN, "_")


#: What the JVM reads otherwise than Python does, whose parser is asked.
_OTHERWISE = r"\\[0v]|\\b\{|&&|\(\?[a-z]*x|\[[^\]]*\["


def required(pattern: str) -> list[list[str]]:
    """Lists of literals, of each of which every match of a pattern has one: what is written out, in lower case where case doesn't count. Single characters only if they
    are neither letters nor digits; the fewest to look for come first, then the longest. None where the pattern doesn't tell."""
    if re.search(_OTHERWISE, pattern):
        return []
    try:
        tree = _parser.parse(pattern)
    except (re.error, RecursionError):
        return []
    fold = bool(tree.state.flags & re.IGNORECASE)
    found = [[x.lower() for x in said] if fold else said for said in _required(tree)]
    found = [x for i, x in enumerate(found) if x not in found[:i] and not (fold and any(not y.isascii() for y in x))]
    return sorted(found, key=lambda x: (len(x), -min(map(len, x))))


def _required(tree) -> list[list[str]]:
    found, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op == _constants.LITERAL:
            run += chr(arg)
            continue
        if op == _constants.AT:
            continue
        found, run = found + [[run]], ""
        if op == _constants.SUBPATTERN and not arg[1] & re.IGNORECASE:
            found += _required(arg[3])
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and arg[0] > 0:
            found += _required(arg[2])
        elif op == _constants.IN and all(x == _constants.LITERAL for x, _ in arg):
            found.append([chr(c) for _, c in arg])
        elif op == _constants.BRANCH:
            each = [_required(b) for b in arg[1]]
            found.append([x for b in each for x in max(b, key=lambda x: min(map(len, x)))] if all(each) else [])
    return [x for x in found if x and len(x) <= 12 and all(len(y) > 1 or y and not y.isalnum() and y.isascii() for y in x)]


def _needs(text: Column, pattern: str, lower: Column | None = None) -> list[Column]:
    """For each thing that every match of the pattern needs, whether text has it. Empty where nothing is told, or case doesn't count and the text in lower case isn't given."""
    fold = pattern.startswith("(?i)")
    if fold and lower is None:
        return []
    one = lambda literals: reduce(lambda a, b: a | b, (F.contains(lower if fold else text, F.lit(x)) for x in literals))
    return [one(x) for x in required(pattern)]


def may_match(text: Column, pattern: str, lower: Column | None = None) -> Column | None:
    """Whether text has what every match of the pattern needs: a search for literals, which takes a small part of the pattern's time. None where nothing is told, or case doesn't count and
    the text in lower case isn't given."""
    needs = _needs(text, pattern, lower)
    return reduce(lambda a, b: a & b, needs) if needs else None


def has(text: Column, pattern: str, lower: Column | None = None) -> Column:
    """rlike, of texts that may match alone."""
    return text.rlike(pattern) if (may := may_match(text, pattern, lower)) is None else may & text.rlike(pattern)


def when_all(conditions: list[Column], value: Column) -> Column:
    """value where all conditions hold, else null, asked one after another. What several conditions that are joined by `and` have in common Spark works out for every row; what stands in a
    branch it works out where the branch is reached."""
    return reduce(lambda inner, condition: F.when(condition, inner), reversed(conditions), value)


def has_steps(text: Column, pattern: str, lower: Column | None = None) -> list[Column]:
    """The conditions of has(), for when_all()."""
    return [*_needs(text, pattern, lower), text.rlike(pattern)]


def count(text: Column, pattern: str) -> Column:
    n = F.regexp_count(text, F.lit(pattern))
    return n if (may := may_match(text, pattern)) is None else F.when(~may, 0).otherwise(n)


def words(text: Column) -> Column:
    """How many runs of characters between ASCII white space there are."""
    return count(text, r"[^ \t\n\f\r]+")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def collapsed(text: Column) -> Column:
    """text with each run of ASCII white space made one space, and none at its ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "))


def glob_to_regex(glob: str) -> str:
    """The regex of a path glob in which * crosses /."""
    escaped = "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "/_-" else "\\" + c) for c in glob)
    return f"^{escaped}$"


def normalize_package(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def severity_rank(severity: Column) -> Column:
    """error 0, warning 1, info 2; others rank as warning."""
    return F.when(severity == "error", 0).when(severity == "info", 2).otherwise(1)
