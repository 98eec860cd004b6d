"""Text normalisation, tokens and keys as column expressions (NFKC and numeric references need Arrow UDFs)."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that the `\\s` of the rule packs means, beside ASCII's.
WIDE_SPACE = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACES = rf"[\s{WIDE_SPACE}]+"
#: Characters that cleaning may change wherever they stand. Single ones up to 255 are looked up in one table; the rest is
#: tried from U+1680 on only, as a class costs a call for each of its ranges at every character of a text.
_WIDE_BITS, _WIDE_REST = r"\x{00A0}", r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_UNCLEAN = rf"[<&\t\n\x0B\f\r{_WIDE_BITS}[\x{{1680}}-\x{{FEFF}}&&[\x{{200B}}-\x{{200D}}\x{{2060}}{_WIDE_REST}]]]"
#: Runs of white space that are not one plain space already.
_ANY_SPACE = rf"[ \t\n\x0B\f\r{_WIDE_BITS}[\x{{1680}}-\x{{FEFF}}&&[{_WIDE_REST}]]]"
_LOOSE_SPACE = rf"[\t\n\x0B\f\r{_WIDE_BITS}[\x{{1680}}-\x{{FEFF}}&&[{_WIDE_REST}]]]{_ANY_SPACE}*| {_ANY_SPACE}+"
_ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}]"
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def regex(pattern: str, ignore_case: bool = True) -> str:
    """A pack's pattern for Spark: ASCII word boundaries, wide white space, case folding over all letters."""
    out, in_class, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if not in_class and (whole := re.match(r"\\b([A-Za-z0-9_]+)\\b", pattern[k:])):
            # A whole word is searched first, then what stands around it is looked at.
            out.append(rf"{whole[1]}(?<!{_WORD}{whole[1]})(?!{_WORD})")
            k += len(whole[0]) - 2
        elif two == r"\b" and not in_class:
            # Beside a plain letter only the other side has to be looked at.
            after = re.match(r"[A-Za-z0-9_](?![?*{])", pattern[k + 2 :])
            before = re.search(r"(?<!\\)[A-Za-z0-9_]$", pattern[:k])
            out.append(rf"(?<!{_WORD})" if after and not before else rf"(?!{_WORD})" if before and not after else _BOUNDARY)
        elif two == r"\s":
            out.append(rf"\s{WIDE_SPACE}" if in_class else rf"[\s{WIDE_SPACE}]")
        elif two == r"\S" and not in_class:
            out.append(rf"[^\s{WIDE_SPACE}]")
        elif two[:1] == "\\":
            out.append(two)
        else:
            in_class = in_class and two[0] != "]" or two[0] == "["
            out.append(two[0])
            k -= 1
        k += 2
    return ("(?iu)" if ignore_case else "") + "".join(out)


def _branches(pattern: str) -> list[str]:
    """A pattern's alternatives."""
    out, depth, in_class, k = [""], 0, False, 0
    while k < len(pattern):
        one = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        if not in_class and one in "()":
            depth += 1 if one == "(" else -1
        in_class = one == "[" or in_class and one != "]"
        if one == "|" and not depth and not in_class:
            out.append("")
        else:
            out[-1] += one
        k += len(one)
    return out


def _addresses(pattern: str) -> bool:
    """Whether every match of an alternative holds an @ (one outside groups, classes and repetitions)."""
    bare = re.sub(r"\[[^\]]*\]|\\.", "x", pattern)
    return "(" not in bare and re.search(r"@(?![?*{])", bare) is not None


def addresses_only(pattern: str) -> bool:
    """Whether the pattern matches nothing without an @."""
    return not re.search(r"\\[1-9Q]", pattern) and all(map(_addresses, _branches(pattern)))


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether the pattern matches. Addresses, whose search reads each word from each of its letters, are looked for where an @ is."""
    if pattern == "(?!)":
        return F.lit(False)  # what a pack lacks matches nothing, and would be tried at each character
    text, branches = F.coalesce(text, F.lit("")), _branches(pattern) if "@" in pattern and not re.search(r"\\[1-9Q]", pattern) else []
    held = [b for b in branches if _addresses(b)]
    if not held:
        return text.rlike(regex(pattern, ignore_case))
    found = text.contains("@") & text.rlike(regex("|".join(held), ignore_case))
    rest = [b for b in branches if b not in held]
    return text.rlike(regex("|".join(rest), ignore_case)) | found if rest else found


def any_matches(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches, in one scan."""
    return matches(text, "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def decode_named(text: Column) -> Column:
    """The six named references that feeds use; & last, so that nothing is decoded twice."""
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.regexp_replace(text, f"(?i)&{name};", char)
    return text


@F.pandas_udf(T.StringType())
def decode_references(text: pd.Series) -> pd.Series:
    """Numeric references and the six named ones; unknown names stay."""

    def one(m: re.Match) -> str:
        name = m[1].lower()
        if name[0] != "#":
            return {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}.get(name, m[0])
        code = int(name[2:], 16) if name[1] == "x" else int(name[1:])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return text.map(lambda t: None if t is None else re.sub(r"&(#x[0-9a-f]{1,8}|#[0-9]{1,9}|[a-z]+);", one, t, flags=re.I))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """All character references of HTML."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def clean(text: Column, decode=decode_named) -> Column:
    """Tags to spaces, then references (so escaped tags survive as text), zero-width characters out, single spaces.

    The text is computed once: most sentences and titles are clean already, and most others have no reference.
    """
    if decode is not decode_named:
        text = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " ")
        return _spaced(decode(text))
    bare = lambda t: let(F.when(t.contains("<"), F.regexp_replace(t, "<[^>]*>", " ")).otherwise(t), lambda b: _spaced(F.when(b.contains("&"), decode(b)).otherwise(b)))
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(_UNCLEAN) | t.contains("  ") | t.startswith(" ") | t.endswith(" "), bare(t)).otherwise(t))


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, _LOOSE_SPACE, " ")


def _spaced(text: Column) -> Column:
    return F.trim(single_spaces(F.regexp_replace(text, _ZERO_WIDTH, "")))


def match_form(text: Column, full: bool = False) -> Column:
    """clean, NFKC if `full`, lower case: the form in which texts are compared."""
    return F.lower(nfkc(clean(text, decode_references)) if full else clean(text))


def contains_keyword(text: Column, keyword: str) -> Column:
    """ASCII keywords as whole words of letters and digits, others as substrings; text in match_form."""
    word = keyword.lower()
    if word.isascii():
        # The word first, then what stands around it: the search goes from one occurrence to the next. Most texts lack it.
        own = re.escape(word)
        return text.contains(word) & text.rlike(rf"{own}(?<![\p{{L}}\p{{N}}]{own})(?![\p{{L}}\p{{N}}])")
    return text.contains(word)


def hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords the text contains."""
    total = F.lit(0)
    for k in keywords:
        total = total + contains_keyword(text, k).cast("int")
    return total


def fingerprint(title: Column, full: bool = False) -> Column:
    """match_form without bracketed parts, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(match_form(title, full), r"\[[^\]]*\]|\([^)]*\)", " "), r"[^\p{L}\p{N}]+", "")


def tokens(text: Column, full: bool = False) -> Column:
    """Distinct tokens of two characters or more."""
    return F.array_distinct(F.filter(F.split(match_form(text, full), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1))


def bigrams(text: Column, full: bool = False) -> Column:
    """Character bigrams of the fingerprint, with repeats."""
    return grams_of(fingerprint(text, full))


def grams_of(form: Column) -> Column:
    own = lambda f: F.when(F.length(f) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(f) - 1, F.lit(1))), lambda i: F.substr(f, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return let(form, own)


def search_form(text: Column) -> Column:
    """Lower case and single spaces, for substring search."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACES, " "))


def search_title(text: Column) -> Column:
    """ASCII letters and digits and Hangul only."""
    return F.regexp_replace(match_form(text), r"[^a-z0-9\x{AC00}-\x{D7A3}]+", "")


def without_particles(text: Column, pack) -> Column:
    """Tokens without the pack's particles and endings, end to end."""
    words = F.split(F.trim(F.regexp_replace(match_form(text), r"[^\p{L}\p{N}]+", " ")), " ")
    cut = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, f"(?:{'|'.join(pack.particles)})$", ""), f"(?:{'|'.join(pack.endings)})$", ""))
    return F.array_join(F.filter(cut, lambda w: (w != "") & ~w.isin(*pack.bare_endings)), "")


def sentences(text: Column) -> Column:
    """Runs up to `.`, `!`, `?` or the ideographic full stop; line ends count as full stops. Decimals split."""
    flat = clean(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n+", ". "))
    return F.filter(F.transform(F.regexp_extract_all(flat, F.lit(r"[^.!?。]+[.!?。]?"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def sentences_with_decimals(text: Column) -> Column:
    """As sentences, but a full stop between digits ends nothing."""
    flat = clean(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n+", ". "))
    return F.filter(F.transform(F.regexp_extract_all(flat, F.lit(r"(?:[^.!?。]|(?<=\d)\.(?=\d))+[.!?。]?"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def mostly_latin(text: Column) -> Column:
    """At least 20 Latin letters, and more than twice the Hangul ones."""
    latin = count_of(text, "[A-Za-z]")
    return (latin >= 20) & (latin > 2 * count_of(text, r"[\x{AC00}-\x{D7A3}]"))


def truncated(text: Column, most: int) -> Column:
    """The text, or its first characters up to the last whole word."""
    whole = clean(text)
    return F.when(F.length(whole) <= most, whole).otherwise(F.trim(F.regexp_replace(F.substring(whole, 1, most), r"\s+\S*$", "")))


def prepared_title(text: Column) -> Column:
    """Without a leading bracketed tag and trailing dots."""
    return F.trim(F.regexp_replace(F.regexp_replace(clean(text), r"^\s*\[[^\]]{1,40}\]\s*", ""), r"[.…·\-\s]+$", ""))


def without_quotes(text: Column) -> Column:
    """Quotes out, ellipses to commas, commas spaced (but not within numbers)."""
    text = F.regexp_replace(F.regexp_replace(text, "[\"'“”‘’「」『』]", ""), r"\s*(?:…|\.{3})\s*", ", ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r",(?!\d)\s*", ", "), SPACES, " "))


@F.pandas_udf(T.IntegerType())
def top_comma(text: pd.Series) -> pd.Series:
    """Place (from 0) of the first comma outside quotes and not within a number; -1 if there is none."""
    pairs = {"“": "”", "‘": "’", '"': '"', "'": "'", "(": ")", "「": "」"}

    def find(t: str | None) -> int:
        open_until = ""
        for k, c in enumerate(t or ""):
            if open_until:
                open_until = "" if c == open_until else open_until
            elif c in pairs:
                open_until = pairs[c]
            elif c in ",，" and not (t[k - 1 : k].isdigit() and t[k + 1 : k + 2].isdigit()):
                return k
        return -1

    return text.map(find)


def _closed(word: Column) -> Column:
    """Whether the word ends in a Hangul syllable with a final consonant."""
    last = F.ascii(F.substring(word, -1, 1))
    return (last >= 0xAC00) & (last <= 0xD7A3) & ((last - 0xAC00) % 28 > 0)


def subject_particle(word: Column) -> Column:
    """The Korean subject particle that fits the word's last syllable."""
    return F.when(_closed(word), F.lit("이")).otherwise(F.lit("가"))


def object_particle(word: Column) -> Column:
    return F.when(_closed(word), F.lit("을")).otherwise(F.lit("를"))


def short_hash(n: int, *parts: Column) -> Column:
    """The first n hex digits of the parts' SHA-256, joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, n)


def article_id(url: Column, title: Column) -> Column:
    return short_hash(16, url, fingerprint(title))


def description_hash(description: Column) -> Column:
    return short_hash(16, clean(description))


def cache_key(url: Column, title: Column, description: Column) -> Column:
    return short_hash(24, url, fingerprint(title), description_hash(description))
