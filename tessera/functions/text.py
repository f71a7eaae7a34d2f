"""Scalar functions over names, paths, options and ranges, as Column expressions; pandas UDFs only where noted.

All functions give null for null input unless said otherwise.
"""

from __future__ import annotations

import posixpath
import re
from collections import Counter
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

IDENT = r"[\p{L}\p{N}_$]"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# --- identifiers at an offset -------------------------------------------------------------------------------------

def partial_identifier(text, offset) -> Column:
    """Longest run of identifier characters that ends at offset."""
    return F.regexp_extract(F.substring(_c(text), F.lit(1), _c(offset)), IDENT + r"*\z", 0)


def qualified_identifier(text, offset) -> Column:
    """As partial_identifier, dots included."""
    return F.regexp_extract(F.substring(_c(text), F.lit(1), _c(offset)), r"[\p{L}\p{N}_$.]*\z", 0)


def chain_start(text, offset) -> Column:
    """Index at which the run of identifier characters and dots that ends at offset begins."""
    return _c(offset) - F.length(qualified_identifier(text, offset))


# --- names ----------------------------------------------------------------------------------------------------------

def first_segment(path) -> Column:
    return F.substring_index(_c(path), ".", 1)


def trim_trailing_dot(path) -> Column:
    return F.regexp_replace(_c(path), r"\.\z", "")


def display_name(binary_name) -> Column:
    """Binary names with / and $ as dotted names."""
    return F.translate(_c(binary_name), "/$", "..")


def simple_name(name) -> Column:
    return F.substring_index(display_name(name), ".", -1)


# --- paths ----------------------------------------------------------------------------------------------------------

def in_or_under(path, directory) -> Column:
    """path is directory or lies below it; /src2 isn't below /src."""
    d = F.regexp_replace(_c(directory) if not isinstance(directory, str) else F.lit(directory), r"(?<=.)/+\z", "")
    inside = F.when(d.endswith("/"), _c(path).startswith(d)).otherwise(_c(path).startswith(F.concat(d, F.lit("/"))))
    return (_c(path) == d) | inside


def relative_path(path, base) -> Column:
    """path without base; "" for base itself; null outside of base."""
    b = F.regexp_replace(_c(base) if not isinstance(base, str) else F.lit(base), r"(?<=.)/+\z", "")
    p = _c(path)
    return F.when(p == b, "").when(p.startswith(F.concat(b, F.lit("/"))), F.substring(p, F.length(b) + 2, F.length(p)))


def normalize_uri(uri) -> Column:
    """Scheme and host in lower case, no doubled or /./ segments, no fragment."""
    u = F.regexp_replace(_c(uri), r"#.*\z", "")
    scheme = F.lower(F.regexp_extract(u, r"\A([A-Za-z][A-Za-z0-9+.-]*:(?://[^/?]*)?)", 1))
    rest = F.substring(u, F.length(scheme) + 1, F.length(u))
    for _ in range(2):  # overlapping matches need a second turn
        rest = F.regexp_replace(rest, r"/(\./)+|/{2,}", "/")
    return F.concat(scheme, rest)


def root_prefix(uri) -> Column:
    """Normalised uri ending in one slash: what all uris below start with."""
    return F.concat(F.regexp_replace(normalize_uri(uri), r"/+\z", ""), F.lit("/"))


@F.pandas_udf(T.StringType())
def resolve_path(path: pd.Series) -> pd.Series:
    """Backslashes, ./ and .. folded; absolute paths and URIs as they are; null for blank input. (pandas UDF)"""

    def one(p):
        if p is None or not p.strip():
            return None
        p = p.strip().replace("\\", "/")
        if p.startswith("/") or "://" in p or p.startswith("jar:"):
            return p
        parts: list[str] = []
        for s in p.split("/"):
            if s == "..":
                del parts[-1:]
            elif s not in ("", "."):
                parts.append(s)
        return "/".join(parts)

    return path.map(one, na_action=None)


# --- hashes and options ---------------------------------------------------------------------------------------------

def content_hash(content) -> Column:
    """Hex SHA-256 of text or bytes; null for null."""
    return F.sha2(_c(content).cast("binary"), 256)


def options_hash(options) -> Column:
    """64-bit hash of a map<string,string> that doesn't depend on the order of its entries."""
    return F.xxhash64(F.to_json(F.array_sort(F.map_entries(_c(options)))))


def option_bool(options, key: str, default: bool = False) -> Column:
    v = _c(options).getItem(key)
    return F.when(v.isNull(), F.lit(default)).otherwise(F.lower(F.trim(v)) == "true")


def option_int(options, key: str, default: int) -> Column:
    return F.coalesce(F.trim(_c(options).getItem(key)).try_cast("int"), F.lit(default))


def option_long(options, key: str, default: int) -> Column:
    return F.coalesce(F.trim(_c(options).getItem(key)).try_cast("long"), F.lit(default).cast("long"))


def truthy(value) -> Column:
    return F.coalesce(F.lower(F.trim(_c(value))).isin("true", "1", "yes", "y", "on"), F.lit(False))


def clamp_range(start, end, position, length) -> Column:
    """A half-open range within [0, length]: bad ranges fall back to the position, empty ones get one character."""
    s, e, p, n = map(_c, (start, end, position, length))
    bad = s.isNull() | e.isNull() | (s < 0) | (e < 0) | (e < s)
    s0 = F.when(bad, F.greatest(F.coalesce(p, F.lit(-1)), F.lit(0))).otherwise(s)
    e0 = F.when(bad, F.when(F.coalesce(p, F.lit(-1)) >= 0, p + 1).otherwise(0)).otherwise(e)
    s1, e1 = F.least(s0, n), F.greatest(F.least(e0, n), F.least(s0, n))
    return F.struct(s1.alias("start"), F.when((s1 == e1) & (s1 < n), s1 + 1).otherwise(e1).alias("end"))


# --- matching -------------------------------------------------------------------------------------------------------

def plain_match(name, prefix) -> Column:
    """Prefix test without regard to case; the empty prefix matches everything."""
    return F.lower(_c(name)).startswith(F.lower(_c(prefix) if not isinstance(prefix, str) else F.lit(prefix)))


def _common_subsequence(a: str, b: str) -> int:
    """Length of a longest common subsequence, a character of b at a time: a row of the table is one integer's bits."""
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    every = (1 << len(a)) - 1
    free = every
    for y in b:
        met = free & at.get(y, 0)
        free = ((free + met) | (free - met)) & every
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> int:
    """Share of characters in a longest common subsequence, in percent: round(200 * lcs / (len a + len b))."""
    total = len(a) + len(b)
    return int(200 * _common_subsequence(a, b) / total + 0.5) if total else 100


def ratio_bound(name, typed: str) -> Column:
    """No less than ratio(name, typed), without aligning the two: a common subsequence has no more of a character than either
    side. A filter on it runs before the alignment and leaves it the few names that can reach a score."""
    n = _c(name)
    shared = reduce(add, [F.least(F.length(n) - F.length(F.replace(n, F.lit(c))), F.lit(k)) for c, k in sorted(Counter(typed).items())], F.lit(0))
    total = F.length(n) + len(typed)
    return F.when(total == 0, 100).otherwise(F.floor(200 * shared / total + 0.5)).cast("int")


def partial_ratio(a: str, b: str) -> int:
    """Best ratio of the shorter text with any stretch of its length in the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100 if not b else 0
    if a in b:
        return 100
    # What a stretch shares with a at most, character by character, is kept up as it slides; only stretches that can beat the
    # best so far are aligned, the most promising first.
    size, need = len(a), Counter(a)
    have = Counter(b[:size])
    shared = sum(min(n, have[c]) for c, n in need.items())
    bounds = [(-shared, 0)]
    for i in range(1, len(b) - size + 1):
        out, new = b[i - 1], b[i + size - 1]
        shared -= have[out] <= need[out]
        have[out] -= 1
        have[new] += 1
        shared += have[new] <= need[new]
        bounds.append((-shared, i))
    best = 0
    for less, i in sorted(bounds):
        if int(-200 * less / (2 * size) + 0.5) <= best:
            break
        best = max(best, ratio(a, b[i : i + size]))
    return best


def token_set_partial_ratio(a: str, b: str) -> int:
    """partial_ratio of the common words with each side's words, and of the sides; word order doesn't count."""
    x, y = ({*re.findall(r"\w+", t.lower())} for t in (a, b))
    both = " ".join(sorted(x & y))
    left, right = (" ".join([*([both] if both else []), *sorted(s)]) for s in (x - y, y - x))
    return max(partial_ratio(both, left), partial_ratio(both, right), partial_ratio(left, right)) if both else partial_ratio(left, right)


def _pairwise(fn):
    @F.pandas_udf(T.IntegerType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for k in zip(a, b):
            if k not in seen:
                seen[k] = None if k[0] is None or k[1] is None else fn(*k)
            out.append(seen[k])
        return pd.Series(out, dtype="Int32")

    return score


#: pandas UDFs of the three measures; each distinct pair of a batch is scored once.
fuzzy_ratio, fuzzy_partial, fuzzy_token_set = map(_pairwise, (ratio, partial_ratio, token_set_partial_ratio))

#: Match levels in order. Fixed values.
LEVELS = ("none", "partial", "ci_prefix", "cs_prefix", "ci_equal", "cs_equal")
#: A name matches fuzzily if its ratio is above this (fixed value), scope members from SCOPE_SCORE on (fixed value).
MINIMUM_SCORE, SCOPE_SCORE = 70, 70


def match_level(name, prefix, fuzzy: bool = True) -> Column:
    """Index in LEVELS of how name matches prefix. Without fuzzy, level 1 isn't told from 0 and no Python runs."""
    n, p = _c(name), _c(prefix) if not isinstance(prefix, str) else F.lit(prefix)
    level = F.when(n == p, 5).when(n.startswith(p), 3).when(F.lower(n) == F.lower(p), 4).when(F.lower(n).startswith(F.lower(p)), 2)
    rest = F.when(fuzzy_ratio(n, p) > MINIMUM_SCORE, 1).otherwise(0) if fuzzy else F.lit(0)
    return level.otherwise(rest)


# --- source text ----------------------------------------------------------------------------------------------------

_SKIP = re.compile(r"(?:\s+|//[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z))*", re.S)


def package_name(text: str | None) -> str:
    """Name after a leading package keyword, comments and blanks skipped; "" if there is none."""
    t = text or ""
    at = _SKIP.match(t).end()
    m = re.compile(r"package(?![\w$])").match(t, at)
    if not m:
        return ""
    out, at = [], m.end()
    while at < len(t):
        at = _SKIP.match(t, at).end()
        if at >= len(t) or t[at] == ";":
            break
        out.append(t[at])
        at += 1
    return "".join(out)


@F.pandas_udf(T.StringType())
def package_of(text: pd.Series) -> pd.Series:
    """package_name of each text. (pandas UDF)"""
    return text.map(package_name, na_action=None)


def pop_up_trigger(inserted, text, caret) -> Column:
    """One of . : ( was typed, or a space after the word new."""
    i = _c(inserted)
    before = F.substring(_c(text), F.lit(1), _c(caret))
    return i.isin(".", ":", "(") | ((i == " ") & before.rlike(r"(?:\A|[^\p{L}\p{N}_$])new \z"))


#: What may stand after a dot or ::, and what then needs the end of a statement before it. Fixed values.
_SELECTS, _CLOSES = ("<", "*"), ("}",)
_TOKENS = re.compile(r'(?:\s|//[^\n]*|/\*.*?(?:\*/|\Z))+|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|\.\.\.|::|\d[\w.]*|[^\W\d][\w$]*|\$[\w$]*|.', re.S)


def patch_incomplete(text: str | None, caret: int | None = None, dummy: str = "anyName") -> str | None:
    """Text as a parser can take it while names are still missing.

    A dot or :: that ends its line gets a dummy name and a semicolon; one that something else than a name, type argument or *
    follows gets a dummy name, before } with a semicolon; so does the place between two dots before a name. If nothing but
    blanks is between the word new and the caret, the caret gets a dummy name with parentheses. Comments and literals are
    passed over. Places are those of the given text: all are found first and patched from the end backwards.
    """
    if text is None:
        return None
    tokens = [(m.start(), m.group()) for m in _TOKENS.finditer(text)]
    solid = [(at, t) for at, t in tokens if not (t[0].isspace() or t.startswith(("//", "/*")))]
    places: list[tuple[int, str]] = []
    for (at, t), (then, u) in zip(solid, [*solid[1:], (len(text), "")]):
        if t not in (".", "::"):
            continue
        end = at + len(t)
        name = bool(u) and (u[0] in "_$" or u[0].isalpha())
        if "\n" in text[end:then]:
            places.append((end, f"{dummy};"))
        elif not (name or u in _SELECTS):
            places.append((end, f"{dummy};" if u in _CLOSES else dummy))
    if caret is not None and caret >= 0:
        before = text[: min(caret, len(text))].rstrip()
        if re.search(r"(?<![\w$])new\Z", before):
            places.append((min(caret, len(text)), f"{dummy}()"))
    for at, insert in sorted(places, reverse=True):
        text = text[:at] + insert + text[at:]
    return text


@F.pandas_udf(T.StringType())
def patched(text: pd.Series, caret: pd.Series) -> pd.Series:
    """patch_incomplete of each text at its caret. (pandas UDF)"""
    return pd.Series([patch_incomplete(t, None if pd.isna(c) else int(c)) for t, c in zip(text, caret)], dtype=object)


def join_path(*parts: str) -> str:
    return posixpath.join(*parts)
