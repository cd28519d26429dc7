"""Format-preserving pseudonyms for personal data (DataFrame functions only).

Each value is read as an array of numbers with a radix for each place (digits 10, letters 26, hex letters 6, IP octets 256, ...), and a keyed Feistel
network permutes the arrays of that format: in turn, one half is shifted, place by place, by SHA-256 of the key, the round and the other
half. So equal values get equal pseudonyms in every document, different values stay different, and the form stays: separators, length and
letter case; cards keep a valid check digit, dates stay dates, IP octets stay below 256. Nothing is stored to link them; the key is an argument and has no default, since whoever has it can turn pseudonyms back.

Kinds: e-mail (the local part, letters of any script: a letter beyond ASCII stays among the 64 characters around it; the domain stays), IPv4 without leading zeros, IPv6, payment
cards of 13 to 19 digits in the groups that cards have and that pass the Luhn test, US social security numbers
in the valid ranges, phone numbers with a country code (which stays) in any grouping or in North American form, ISO and US dates that exist (permuted within the 146,097 days
from 1800 to 2199), and secrets of 32 or more hex digits. Numbers that fail their test are left alone.

Defined cases: null text stays null with 0 values; empty texts stay; the same value twice gets the same pseudonym twice, in rows that repeat an id or have none too; a text of any length is scanned whole; an empty table gives
an empty result; all columns of the input stay, and only ``text`` changes. The number of values that changed is the column ``n_pii``, or any other
name asked for; a column of that name in the input gives way to it. A permutation may leave a value as it is, which then isn't counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ROUNDS = 8

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HEX4 = "[0-9a-fA-F]{1,4}"
#: Alternatives in order of preference; every one starts at the first character of a run, so scanning stays linear.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}0-9._%+-])[\p{L}\p{M}0-9._%+-]++@(?:[\p{L}0-9-]++\.)+\p{L}{2,}",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[0-9a-fA-F:]*[0-9])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{2,6}}(?::{_HEX4}){{1,5}})(?![0-9A-Za-z:])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])",
    "usdate": r"(?<![0-9A-Za-z/])(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/[0-9]{4}(?![0-9A-Za-z/])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+])(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|[2-9][0-9]{2} [2-9][0-9]{2}[ -][0-9]{4})(?![0-9A-Za-z]|[.-][0-9])",
    "card": r"(?<![0-9A-Za-z-])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9A-Za-z]|-[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Country codes of one and of two digits; all others have three.
COUNTRY = "^[+](?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _chars(value: str) -> str:
    return f"regexp_extract_all({value}, '(?s).', 0)"


def kind_of(value: str) -> str:
    """SQL for the kind of a whole match, null where its test fails."""
    digits = f"transform(regexp_extract_all({value}, '[0-9]', 0), c -> int(c))"
    luhn = (
        f"aggregate(transform(reverse({digits}), (d, i) -> if(i % 2 = 1, if(d > 4, 2 * d - 9, 2 * d), d)), 0, (a, d) -> a + d) % 10 = 0"
        f" AND array_max({digits}) > 0"
    )
    tests = {
        "date": f"try_to_date({value}, 'yyyy-MM-dd') BETWEEN date'1800-01-01' AND date'2199-12-31'",
        "usdate": f"try_to_date({value}, 'MM/dd/yyyy') BETWEEN date'1800-01-01' AND date'2199-12-31'",
        "ssn": f"NOT {value} RLIKE '^(000|666|9)|-00-|0000$'",
        "card": luhn,
    }
    whens = " ".join(f"WHEN {value} RLIKE '^(?:{_sql(p)})$' AND {tests.get(k, 'true')} THEN '{k}'" for k, p in PATTERNS.items())
    return f"CASE {whens} END"


def _feistel(v: str, radix: str, kind: str, key: str) -> str:
    """SQL: ``v`` permuted among the arrays with these radices. Half an array of one place is empty, which leaves a keyed shift."""
    n = f"(size({v}) div 2)"
    other = f"if(r % 2 = 0, slice(acc, {n} + 1, size(acc) - {n}), slice(acc, 1, {n}))"
    shift = (
        f"cast(conv(substring(sha2(concat_ws('|', '{_sql(key)}', {kind}, r, i div 8, array_join({other}, ',')), 256), 1 + 8 * (i % 8), 8), 16, 10) AS bigint)"
    )
    step = f"transform(acc, (x, i) -> if((i < {n}) = (r % 2 = 0), int((x + {shift}) % {radix}[i]), x))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {v}, (acc, r) -> {step})"


def pseudonym(value: str, key: str) -> str:
    """SQL for the pseudonym of the string expression ``value``, a match of ``ANY``; values that fail their test are returned as they are."""
    # places: what is permuted, as numbers; the other characters stay where they are
    foreign = "ascii(c) BETWEEN 128 AND 65535 AND c RLIKE '\\\\p{L}'"
    char_radix = f"CASE WHEN c RLIKE '[0-9]' THEN 10 WHEN c RLIKE '[a-zA-Z]' THEN if(k IN ('secret', 'ipv6'), 6, 26) WHEN {foreign} THEN 64 ELSE 1 END"
    char_value = f"CASE WHEN c RLIKE '[0-9]' THEN int(c) WHEN c RLIKE '[a-z]' THEN ascii(c) - 97 WHEN c RLIKE '[A-Z]' THEN ascii(c) - 65 WHEN {foreign} THEN ascii(c) % 64 ELSE 0 END"
    day = lambda form: f"transform(array(datediff(to_date(m, '{form}'), date'1800-01-01')), n -> array(string(n div 773), string(n % 773)))[0]"
    cs = f"CASE k WHEN 'email' THEN {_chars("substring_index(m, '@', 1)")} WHEN 'ip' THEN split(m, '\\\\.') WHEN 'date' THEN {day('yyyy-MM-dd')} WHEN 'usdate' THEN {day('MM/dd/yyyy')} WHEN 'ssn' THEN split(m, '-') WHEN 'phone' THEN {_chars(f"regexp_replace(m, '{COUNTRY}', '')")} ELSE {_chars('m')} END"
    # of a card, the last digit is computed; of an SSN, each group has its own range
    radix = (
        f"CASE WHEN k = 'ip' THEN transform(cs, c -> 256) WHEN k IN ('date', 'usdate') THEN array(189, 773) WHEN k = 'ssn' THEN array(898, 99, 9999)"
        f" WHEN k = 'card' THEN transform(cs, (c, i) -> if(i = size(cs) - 1, 1, {char_radix})) ELSE transform(cs, c -> {char_radix}) END"
    )
    vals = (
        f"CASE WHEN k IN ('ip', 'date', 'usdate') THEN transform(cs, c -> int(c))"
        f" WHEN k = 'ssn' THEN array(int(cs[0]) - if(int(cs[0]) > 666, 2, 1), int(cs[1]) - 1, int(cs[2]) - 1)"
        f" WHEN k = 'card' THEN transform(cs, (c, i) -> if(i = size(cs) - 1, 0, {char_value})) ELSE transform(cs, c -> {char_value}) END"
    )
    shown = "transform(cs, (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN string(out[i]) WHEN c RLIKE '[a-z]' THEN char(97 + out[i]) WHEN c RLIKE '[A-Z]' THEN char(65 + out[i]) WHEN radix[i] = 64 THEN decode(unhex(lpad(hex(ascii(c) - ascii(c) % 64 + out[i]), 4, '0')), 'UTF-16BE') ELSE c END)"
    # the check digit of a card: digits before it, from the right, with the first doubled
    body = "regexp_extract_all(substring(joined, 1, length(joined) - 1), '[0-9]', 0)"
    check = f"string(pmod(-aggregate(transform(reverse({body}), (c, i) -> if(i % 2 = 0, if(int(c) > 4, 2 * int(c) - 9, 2 * int(c)), int(c))), 0, (a, d) -> a + d), 10))"
    card = _let(f"array_join({shown}, '')", "joined", f"concat(substring(joined, 1, length(joined) - 1), {check})")
    area = "out[0] + if(out[0] >= 665, 2, 1)"
    rendered = (
        f"CASE k WHEN 'email' THEN concat(array_join({shown}, ''), substring(m, length(substring_index(m, '@', 1)) + 1))"
        " WHEN 'ip' THEN array_join(out, '.')"
        " WHEN 'date' THEN string(date_add(date'1800-01-01', out[0] * 773 + out[1]))"
        " WHEN 'usdate' THEN date_format(date_add(date'1800-01-01', out[0] * 773 + out[1]), 'MM/dd/yyyy')"
        f" WHEN 'ssn' THEN concat(lpad(string({area}), 3, '0'), '-', lpad(string(out[1] + 1), 2, '0'), '-', lpad(string(out[2] + 1), 4, '0'))"
        f" WHEN 'phone' THEN concat(regexp_extract(m, '{COUNTRY}', 0), array_join({shown}, '')) WHEN 'card' THEN {card}"
        f" ELSE array_join({shown}, '') END"
    )
    body = _let(cs, "cs", _let(radix, "radix", _let(vals, "vals", _let(_feistel("vals", "radix", "k", key), "out", rendered))))
    return _let(value, "m", _let(kind_of("m"), "k", f"if(k IS NULL, m, {body})"))


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_pii") -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced; ``count_col`` (unless None) holds how many changed."""
    text, any_ = f"`{text_col}`", _sql(ANY)
    found = unused("found", docs)
    likely = f"{text} RLIKE '[@0-9]'"  # every pattern needs one of these
    pair = f"transform(regexp_extract_all({text}, '{any_}', 0), m -> named_struct('m', m, 'p', {pseudonym('m', key)}))"
    # the pieces between matches alternate with the matches' pseudonyms
    joined = f"array_join(zip_with(split({text}, '{any_}', -1), {found}, (piece, x) -> concat(piece, coalesce(x.p, ''))), '')"
    again = f"if({found} IS NULL OR size({found}) = 0, {text}, {joined})"
    held = docs.select("*", F.expr(f"if({likely}, {pair}, NULL)").alias(found))
    cols: list[Column] = [F.expr(again).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col]
    if count_col:
        counted = F.expr(f"if({found} IS NULL, 0, size(filter({found}, x -> x.p <> x.m)))").cast("long")
        cols.append(counted.alias(count_col))
    return held.select(*cols)
