"""Types of strings: numbers, addresses, places, dates, paths and arrays of them.

One ordered table of rules, each an anchored pattern with a test and values, decides; the first rule that fits wins. As one
built-in expression the table is past what the JVM compiles, so that it runs over Arrow batches, a rule at a time over all
strings of a batch that may fit it.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

YEAR, MONTH, DAY = "(19[0-9]{2}|20[0-9]{2}|2100)", "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"
DAY_NAMES = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
LONG_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTHS_FOUND = pa.array([m[:3] for m in LONG_MONTHS])
MONTH_NAMES = "(" + "|".join([m for m in LONG_MONTHS] + [m[:3] for m in LONG_MONTHS if m != "May"]) + ")"
TIME = r"([01]?[0-9]|2[0-3]):([0-5]?[0-9])(?::([0-5]?[0-9])(?:\.([0-9]+))?)?"
ORDINAL = "(1st|21st|31st|2nd|22nd|3rd|23rd|(?:[4-9]|1[0-9]|20|2[4-9]|30)th|0[4-9]th|01st|02nd|03rd)"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4 = r"\.".join([OCTET] * 4)
HEX = "[0-9A-Fa-f]{1,4}"
TIME_ZONE = r"(?:[Zz]|([+-])([01][0-9]|2[0-3]):?([0-5][0-9]))?"
UNIT_MS = {"y": 31536000000, "M": 2592000000, "w": 604800000, "d": 86400000, "h": 3600000, "H": 3600000, "m": 60000, "s": 1000}
SHIFT = re.compile("([+-][0-9]+)([yMwdhHms])")
REST = "[^\n\r\x85\u2028\u2029]"
SPACE = " \t\n\r\f\v"

#: Types that arrays of one type take theirs from; arrays of any other type are plain arrays.
ARRAYED = {"Integer", "Float", "String", "Boolean", "DateMath", "LogDate", "ISO8601Date", "FullDate", "RFC2822Date", "AmericanDate", "EuropeanDate", "VerboseDate", "FinancialDate", "GenericDate", "IPAddressV4", "IPAddressV6", "Geo", "File"}
#: An element: quoted parts and anything but commas and brackets; nested arrays are unwrapped into their elements.
ELEMENT = re.compile(r'(?:"[^"]*"?|[^,"\[\]])+')


def month_of(names) -> np.ndarray:
    return np.asarray(pc.index_in(pc.utf8_slice_codeunits(names, 0, 3), MONTHS_FOUND).fill_null(-1)) + 1


def ints(digits) -> np.ndarray:
    """Numbers of a group; 0 where the group has no part in the match."""
    return np.asarray(pc.if_else(pc.equal(digits, ""), "0", digits).cast(pa.int64()))


def listed(texts) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def floats(texts) -> np.ndarray:
    return np.array([float(x) for x in listed(texts)], "float64")


def month_start(year, month) -> np.ndarray:
    """Days from 1970 to the month's first day."""
    return ((year - 1970) * 12 + month - 1).astype("datetime64[M]").astype("datetime64[D]").astype("int64")


def day_ms(year, month, day) -> np.ndarray:
    """Milliseconds of a day in UTC; days past the month's end run on into the next."""
    return (month_start(year, month) + day - 1) * 86400000


def time_ms(h, m, s, fraction) -> np.ndarray:
    thousandths = pc.utf8_rpad(pc.utf8_slice_codeunits(fraction, 0, 3), 3, "0")
    return ints(h) * 3600000 + ints(m) * 60000 + ints(s) * 1000 + ints(thousandths)


def zone_ms(sign, h, m) -> np.ndarray:
    return np.where(np.asarray(pc.equal(sign, "-")), -1, 1) * (ints(h) * 60 + ints(m)) * 60000


def inside(year, month, day) -> np.ndarray:
    return day <= month_start(year, month + 1) - month_start(year, month)


def count(s, part: str) -> np.ndarray:
    return np.asarray(pc.count_substring(s, part))


class Rule(NamedTuple):
    """``also``, ``value`` and ``second`` take strings of the pattern and their groups, all at once."""

    tag: str
    pattern: str
    needs: int  # of the classes of bytes in a string, those of which it has one, and those that it has no other than
    has_only: int
    begins: np.ndarray
    also: Callable | None
    value: Callable | None
    second: Callable | None


def math_ms(s: str, now: float) -> float:
    """Date arithmetic: the shifts before the first slash, then rounding down to a unit."""
    moved, (shifts, slash, unit) = float(now), s.partition("/")
    for n, of in SHIFT.findall(shifts):
        moved += float(n) * UNIT_MS[of]
    step = UNIT_MS[unit[0]] if slash else 1
    return math.floor(moved / step) * float(step) if slash and math.isfinite(moved) else moved


#: The class of each byte, as a bit: most rules are ruled out by the classes in a string and its first byte alone.
CLASSES = [".", ":", ",", "-", "/", " ", "+", "_~", "0123456789", "abcdefABCDEF", "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ"]
CLASS_OF = np.full(256, 1 << len(CLASSES), "uint16")
for _i, _class in enumerate(CLASSES):
    CLASS_OF[list(_class.encode())] = 1 << _i


def classes(characters: str) -> int:
    return int(np.bitwise_or.reduce(CLASS_OF[list(characters.encode())], initial=0))


#: Bytes that rules begin with, and those made of some classes only.
BEGINS = {"LogDate": SPACE + "MTWFS", "VerboseDate": SPACE + "MTWFS", "RFC2822Date": "MTWFS", "DateMath": "n", "Boolean": "tf", "Null": "n", "File": "/", "IPAddressV6": ":0123456789abcdefABCDEF", "FinancialDate": SPACE + "0123456789"}
NUMERIC = "+-.0123456789"
HAS_ONLY = {"IPAddressV6": "0a:.", "IPAddressV4": "0.", "Geo": "0.,+-", "Float": "0a.+-", "ISO8601Date": "0t-:.+", "FullDate": "0at-", "Integer": "0+-", "Boolean": "at", "Null": "at", "File": "0at/._-"}


def table_of_rules() -> list[Rule]:
    out = []

    def rule(tag, pattern, value=None, also=None, second=None, needs="") -> None:
        begins = np.zeros(256, bool)
        begins[list(BEGINS.get(tag, NUMERIC).encode())] = True
        numbers = itertools.count(1)
        # Arrow wants groups named, and its \s has no vertical tab.
        named = re.sub(r"\((?!\?)", lambda _: f"(?P<g{next(numbers)}>", pattern).replace(r"\s", f"[{SPACE}]")
        out.append(Rule(tag, rf"\A(?:{named})\z", classes(needs), classes(HAS_ONLY[tag]) if tag in HAS_ONLY else 0xFFFF, begins, also, value, second))

    full6 = rf"{HEX}(?::{HEX}){{7}}"
    short6 = rf"(?:{HEX}(?::{HEX}){{0,6}})?::(?:(?:{HEX}:){{0,5}}(?:{HEX}|{V4}))?"
    rule("IPAddressV6", f"{full6}|{short6}", also=lambda s, g: count(s, ":") <= 8, needs=":")
    rule("IPAddressV4", V4, lambda s, g, now: ((ints(g[1]) * 256 + ints(g[2])) * 256 + ints(g[3])) * 256 + ints(g[4]), needs=".")
    place = r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)),([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"
    rule("Geo", place, lambda s, g, now: floats(g[1]), lambda s, g: (abs(floats(g[1])) < 90) & (abs(floats(g[2])) < 180), lambda s, g, now: floats(g[2]), needs=",")
    rule("Float", r"[+-]?[0-9]+\.(?:[0-9]+(?:[eE][+-]?[0-9]+)?)?|[+-]?[0-9]+[eE][+-]?[0-9]+", lambda s, g, now: floats(s), needs=".eE")
    rule("DateMath", rf"now(?:[+-][0-9]+[yMwdhHms])*(?:/[yMwdhHms]{REST}*)?", lambda s, g, now: [math_ms(*x) for x in zip(listed(s), now.to_pylist(), strict=True)], needs="now")
    rule("LogDate", rf"\s*{DAY_NAMES}\s+{MONTH_NAMES}\s+{DAY}\s+{TIME}\s+{YEAR}(?:\s{REST}*)?", lambda s, g, now: day_ms(ints(g[7]), month_of(g[1]), ints(g[2])) + time_ms(*g[3:7]), lambda s, g: count(s, ":") >= 2, needs=":")
    rule("ISO8601Date", rf"{YEAR}-{MONTH}-{DAY}[Tt]([01][0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9])(?:\.([0-9]+))?)?{TIME_ZONE}", lambda s, g, now: day_ms(*map(ints, g[1:4])) + time_ms(*g[4:8]) - zone_ms(*g[8:11]), lambda s, g: np.asarray(pc.find_substring(pc.ascii_upper(s), "T")) >= 10, needs="-")
    rule("RFC2822Date", rf"{DAY_NAMES},\s*{DAY}\s+{MONTH_NAMES}\s+{YEAR}\s+{TIME}\s+(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):?[0-5][0-9])(?:\s{REST}*)?", lambda s, g, now: day_ms(ints(g[3]), month_of(g[2]), ints(g[1])) + time_ms(*g[4:8]), lambda s, g: count(s, ":") >= 2, needs=",")
    for tag, pattern, m, d in (("AmericanDate", rf"{MONTH}/{DAY}", 1, 2), ("EuropeanDate", rf"{DAY}/{MONTH}", 2, 1)):
        # A time that isn't one counts as midnight.
        rule(tag, rf"{pattern}/{YEAR}(?: (?:{TIME}|[^/]*))?", lambda s, g, now, m=m, d=d: day_ms(ints(g[3]), ints(g[m]), ints(g[d])) + time_ms(*g[4:8]), needs="/")
    ordinal = lambda day, month, year: day_ms(ints(year), month_of(month), ints(pc.ascii_rtrim(day, "stndrh")))
    rule("VerboseDate", rf"\s*{DAY_NAMES},?\s+the\s+{ORDINAL}\s+of\s+{MONTH_NAMES},?\s+{YEAR}(?:\s{REST}*)?", lambda s, g, now: ordinal(*g[1:4]), lambda s, g: count(s, ",") >= 2, needs=",")
    rule("FinancialDate", rf"\s*{ORDINAL}\s+{MONTH_NAMES}\s+{YEAR}(?:\s{REST}*)?", lambda s, g, now: ordinal(*g[1:4]), needs=" ")
    full = lambda g: (ints(g[1]), np.maximum(ints(g[2]), month_of(g[3])), np.maximum(ints(g[4]), 1))
    rule("FullDate", rf"{YEAR}-(?:{MONTH}|{MONTH_NAMES})-(?:{DAY}|{DAY_NAMES})", lambda s, g, now: day_ms(*full(g)), lambda s, g: inside(*full(g)), needs="-")
    one_of = lambda s, g: np.asarray(pc.equal(g[2], g[4])) & ((np.asarray(pc.utf8_length(s)) == 10) | (count(s, ":") >= 2))
    generic = lambda g: (ints(g[1]), ints(g[3]), ints(g[5]))
    rule("GenericDate", rf"{YEAR}([-/.])(0[1-9]|1[0-2])([-/.])(0[1-9]|[12][0-9]|3[01])(?: (?:{TIME}|{REST}{{8,}}))?", lambda s, g, now: day_ms(*generic(g)) + time_ms(*g[6:10]), lambda s, g: inside(*generic(g)) & one_of(s, g), needs="-/.")
    rule("Integer", "[+-]?[0-9]+", lambda s, g, now: [0.0 if len(x.lstrip("+-")) > 20 else float(x) for x in listed(s)])
    rule("Boolean", "true|false", lambda s, g, now: pc.equal(s, "true").cast(pa.float64()))
    rule("File", r"(?:/[A-Za-z0-9._~-]+)+/?", needs="/")
    rule("Null", "null")
    return out


RULES = table_of_rules()


def matched(rule: Rule, s, valued: bool):
    """Which of the strings fit the rule, and the groups of these, from 1; a group without a part in its match is empty.

    Groups are left out where neither values nor a test need them.
    """
    if "(?P<" not in rule.pattern or not (valued or rule.also):
        fits, groups = np.asarray(pc.match_substring_regex(s, rule.pattern)), []
    else:
        found = pc.extract_regex(s, rule.pattern)
        fits = np.asarray(found.is_valid())
        groups = [None, *[x.fill_null("") for x in found.filter(pa.array(fits)).flatten()]]
    if rule.also and fits.any():
        kept = rule.also(s.filter(pa.array(fits)), groups)
        groups = groups[:1] + [x.filter(pa.array(kept)) for x in groups[1:]]
        fits[fits] = kept
    return fits, groups


def typed(s, now=None):
    """Strings' rules, by number, and their values; STRING for those that fit none. None is empty. Values are 0 without ``now``."""
    rules, values = np.full(len(s), STRING, "int8"), np.zeros((2, len(s)))
    if not len(s):
        return rules, values
    starts, data = (np.frombuffer(b, t) for b, t in zip(s.buffers()[1:], ("int32", "uint8"), strict=True))
    starts = starts[s.offset : s.offset + len(s) + 1]
    has, first = np.bitwise_or.reduceat(CLASS_OF[data[: starts[-1]]], starts[:-1]), data[starts[:-1]]
    for i, rule in enumerate(RULES):
        at = rule.begins[first] & (rules == STRING) & ((has & ~np.uint16(rule.has_only)) == 0)
        if rule.needs:
            at &= (has & rule.needs) != 0
        at = np.flatnonzero(at)
        if len(at):
            candidates = s.take(pa.array(at))
            fits, groups = matched(rule, candidates, now is not None)
            at = at[fits]
            rules[at] = i
            if now is not None and rule.value and len(at):
                those, clocks = candidates.filter(pa.array(fits)), now.take(pa.array(at))
                for v, f in zip(values, (rule.value, rule.second), strict=True):
                    if f:
                        v[at] = f(those, groups, clocks)
    return rules, values


#: Every type, by the rules' numbers, then those of arrays of one type in the same order.
TAGS = [r.tag for r in RULES] + ["String", "Array"]
STRING, ARRAY = len(RULES), len(RULES) + 1
KINDS = pa.array(TAGS + [f"{t}Array" if t in ARRAYED else "Array" for t in TAGS])


def elements_of(s):
    """The elements of bracketed texts that have any, and of each element the text it is of."""
    inner = pc.utf8_slice_codeunits(s, 1, -1)
    quoted = pc.match_substring(inner, '"')
    at, plain = pc.indices_nonzero(quoted), pc.indices_nonzero(pc.invert(quoted))
    # Without quotes, elements are what lies between commas and brackets.
    split = pc.split_pattern_regex(inner.take(plain), r"[,\[\]]")
    found = [ELEMENT.findall(x) for x in listed(inner.take(at))]
    parts = pa.concat_arrays([split.flatten(), pa.array([p for f in found for p in f], pa.string())])
    of = np.concatenate([np.asarray(plain)[np.asarray(pc.list_parent_indices(split))], np.repeat(np.asarray(at), [len(f) for f in found])])
    parts = pc.utf8_trim(parts, SPACE)
    some = pc.not_equal(parts, "")
    order = np.argsort(of[np.asarray(some)], kind="stable")
    return parts.filter(some).take(pa.array(order)), of[np.asarray(some)][order]


def arrays_of(s) -> tuple[np.ndarray, np.ndarray]:
    """The types and counts of bracketed texts: of one type, mixed, or String from the first unquoted element that is one."""
    kinds, counts = np.full(len(s), ARRAY), np.zeros(len(s), "int64")
    parts, of = elements_of(s)
    if len(parts):
        rules = typed(parts)[0].astype("int64")
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        size, text = np.diff(begin, append=len(of)), of[begin]
        least, most = np.minimum.reduceat(rules, begin), np.maximum.reduceat(rules, begin)
        place = np.arange(len(of)) - np.repeat(begin, size)
        loose = (rules == STRING) & ~np.asarray(pc.starts_with(parts, '"'))
        first = np.minimum.reduceat(np.where(loose, place, len(of)), begin)
        kinds[text] = np.where(first < len(of), STRING, np.where(least == most, least + len(TAGS), ARRAY))
        counts[text] = np.minimum(first, size)
    return kinds, counts


def classified(s, now) -> list:
    """The four columns of the result for strings of which none is null."""
    kinds, counts, values = np.full(len(s), STRING), np.ones(len(s), "int64"), np.zeros((2, len(s)))
    length = pc.binary_length(s)
    bracketed = pc.and_(pc.and_(pc.starts_with(s, "["), pc.ends_with(s, "]")), pc.greater(length, 1))
    single = np.flatnonzero(np.asarray(pc.and_not(pc.greater(length, 0), bracketed)))
    kinds[single], values[:, single] = typed(s.take(pa.array(single)), now.take(pa.array(single)))
    several = np.flatnonzero(np.asarray(bracketed))
    if len(several):
        kinds[several], counts[several] = arrays_of(s.take(pa.array(several)))
    return [KINDS.take(pa.array(kinds)), pa.array(counts), *map(pa.array, values)]


RESULT = StructType([StructField("kind", StringType()), StructField("element_count", LongType()), StructField("numeric_value_1", DoubleType()), StructField("numeric_value_2", DoubleType())])


def of_batch(strings, clocks):
    known = strings.is_valid()
    at = pc.indices_nonzero(known)
    columns = classified(strings.take(at).cast(pa.string()), clocks.take(at))
    if strings.null_count:
        back = pc.if_else(known, pc.subtract(pc.cumulative_sum(known.cast(pa.int64())), 1), None)
        columns = [c.take(back) for c in columns]
    return pa.StructArray.from_arrays(columns, names=RESULT.names, mask=strings.is_null())


#: Strings, and bytes of them, that are taken together: a rule costs as much again for every lot.
LOT, LOT_BYTES = 40_000, 1 << 23


@F.arrow_udf(RESULT)
def of_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + len(batch[0]), size + batch[0].nbytes
        if rows >= LOT or size >= LOT_BYTES:
            yield of_batch(*map(pa.concat_arrays, zip(*held, strict=True)))
            held, rows, size = [], 0, 0
    if held:
        yield of_batch(*map(pa.concat_arrays, zip(*held, strict=True)))


def classify(s: Column, now_ms: Column | None = None) -> Column:
    """``kind``, ``element_count``, ``numeric_value_1``, ``numeric_value_2`` of a string.

    The values are a number's, an address's, latitude and longitude, or a date's milliseconds in UTC. ``now_ms`` is the
    clock of date arithmetic, by default the query's own. Empty text is a String; null gives null.
    """
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    return of_batches(s, now.cast("double"))
