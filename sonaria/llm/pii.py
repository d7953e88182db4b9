"""Format-preserving pseudonyms for personal data, in SQL expressions only.

One pattern finds all candidates of a text. Card and account numbers, phone
numbers, addresses and dates are validated, and what is valid is permuted by a
keyed Feistel network inside the values of its own format: a card number maps
to a card number with a right check digit, a date to a date written the same
way. A permutation maps equal values to equal values and different values to
different values, so documents stay linked and counts stay right. Mail names
and secrets go through a network of the same kind, whose halves are strings and
whose rounds move each character inside its class. What isn't valid stays, and
no pseudonym is invalid, so the two can't meet.
"""

from __future__ import annotations

import functools
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8

#: name -> pattern, in the order in which they are tried at a place. Nothing is matched inside a longer number or word.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.-]{6,128}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z])\+[2-9][0-9]{0,2}(?:[ -]?(?:\([0-9]{1,5}\)|[0-9]{2,5})){2,5}(?![0-9])"
    r"|(?<![0-9A-Za-z.-])(?:1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z.-])(?:1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])",
}


def _any_pattern() -> str:
    """All patterns as one. Places inside a word or number fail at once, and what can't begin there isn't tried. No
    group captures, but for the separators of card numbers."""
    letters, digits = ("|".join(f"(?:{PATTERNS[k]})" for k in kinds) for kinds in (("secret", "iban"), ("ip", "date", "ssn", "phone", "card")))
    return f"(?<![0-9A-Za-z])(?:(?:{PATTERNS['email']})|(?=[0-9A-Fa-f]{{1,4}}:)(?:{PATTERNS['ip6']})|(?=[A-Za-z])(?:{letters})|(?=[0-9+(])(?:{digits}))"


ANY = _any_pattern()


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _word(key: str, kind: str, round_: str, x: str) -> str:
    """A keyed 48-bit word."""
    return f"cast(conv(substr(sha2(concat({_quoted(key + '|' + kind + '|')}, {round_}, '|', {x}), 256), 1, 12), 16, 10) as bigint)"


def _feistel(key: str, kind: str, a: str, ma: str, b: str, mb: str) -> str:
    """Permute (a, b) of 0..ma-1 and 0..mb-1. Each round adds a keyed function of one half to the other, modulo
    its size; an even number of rounds puts the halves back in their places."""
    step = f"cast(pmod(s.a + {_word(key, kind, 'i', 's.b')}, s.ma) as bigint)"
    first = f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint), 'ma', cast({ma} as bigint), 'mb', cast({mb} as bigint))"
    return f"aggregate(sequence(1, {ROUNDS}), {first}, (s, i) -> named_struct('a', s.b, 'b', {step}, 'ma', s.mb, 'mb', s.ma))"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _pad(x: str, n: str) -> str:
    return f"lpad(cast({x} as string), {n}, '0')"


def _digits_feistel(key: str, kind: str, d: str) -> str:
    """Permute a string of 2 to 36 digits within its length."""
    n, h = f"length({d})", f"cast(length({d}) / 2 as int)"
    r = _feistel(key, kind, f"substr({d}, 1, {h})", f"cast(rpad('1', {h} + 1, '0') as bigint)", f"substr({d}, {h} + 1)", f"cast(rpad('1', {n} - {h} + 1, '0') as bigint)")
    return _let(r, "f", f"concat({_pad('f.a', h)}, {_pad('f.b', f'{n} - {h}')})")


def _rewritten(m: str, d: str) -> str:
    """m with its digits replaced by those of d, in order; everything else stays."""
    fill = """aggregate(split({m}, ''), named_struct('t', '', 'k', 1),
        (s, c) -> if(c rlike '^[0-9]$', named_struct('t', concat(s.t, substr(w, s.k, 1)), 'k', s.k + 1), named_struct('t', concat(s.t, c), 'k', s.k)), s -> s.t)"""
    return _let(d, "w", fill.format(m=m))


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str, skip: int) -> str:
    """The Luhn sum of digits, the last `skip` places being those right of them."""
    return f"""aggregate(sequence(1, length({d})), 0, (s, i) -> s + transform(array(cast(substr({d}, length({d}) + 1 - i, 1) as int)),
        v -> if((i + {skip}) % 2 = 0, if(v > 4, 2 * v - 9, 2 * v), v))[0])"""


def _card(key: str, m: str) -> str:
    """The body is permuted, the check digit follows from it. A body of zeros is no card: what would get it is permuted
    once more."""
    body = _let(_digits_feistel(key, "card", "substr(d, 1, length(d) - 1)"), "y", f"if(y rlike '[1-9]', y, {_digits_feistel(key, 'card', 'y')})")
    new = _let(body, "p", f"concat(p, cast(pmod(10 - {_luhn('p', 1)} % 10, 10) as string))")
    return _let(_digits(m), "d", f"if({_luhn('d', 0)} % 10 = 0 and d rlike '[1-9]', {_rewritten(m, new)}, {m})")


def _mod97(s: str) -> str:
    """A string of digits and capital letters (A is 10) modulo 97."""
    return f"""aggregate(split({s}, ''), 0, (r, c) -> if(c rlike '[A-Z]', (r * 100 + ascii(c) - 55) % 97, if(c = '', r, (r * 10 + cast(c as int)) % 97)))"""


def _iban(key: str, m: str) -> str:
    """The account's digits are permuted, the check digits follow from the account and the country."""
    account = _rewritten("substr(d, 5)", _let(_digits("substr(d, 5)"), "e", _digits_feistel(key, "iban", "e")))
    check = _pad("98 - " + _mod97("concat(p, substr(d, 1, 2), '00')"), "2")
    new = _let(account, "p", f"concat({check}, {_digits('p')})")
    valid = "substr(d, 3, 2) between '02' and '98' and " + _mod97("concat(substr(d, 5), substr(d, 1, 4))") + " = 1 and length(" + _digits("substr(d, 5)") + ") > 1"
    return _let(f"replace({m}, ' ', '')", "d", f"if({valid}, {_rewritten(m, new)}, {m})")


def _ip(key: str, m: str) -> str:
    parts = f"transform(split({m}, '[.]'), o -> cast(o as int))"
    r = _feistel(key, "ip", "q[0] * 256 + q[1]", "65536", "q[2] * 256 + q[3]", "65536")
    new = _let(r, "f", "concat_ws('.', cast(f.a div 256 as string), cast(f.a % 256 as string), cast(f.b div 256 as string), cast(f.b % 256 as string))")
    return _let(parts, "q", f"if(array_max(q) < 256 and not {m} rlike '(^|[.])0[0-9]', {new}, {m})")


def _ip6(key: str, m: str) -> str:
    """Up to eight groups, as they are written; the places of digits, letters and colons stay."""
    return f"if(size(filter(split({m}, ':'), g -> g <> '')) <= 8 and {m} rlike '[0-9]', {_string_feistel(key, 'ip6', m, 6)}, {m})"


#: The Gregorian calendar repeats after 146,097 = 189 * 773 days. Dates are permuted within their 400 years, counted from
#: 1800; 88,497 = 9 * 9833 of their days are the 13th of a month or later, some 18.437 of a month.
YEARS, DAYS, LATE, LATE_OF_MONTH = (200, 9799), (189, 773), (9, 9833), 88497 / 4800


def _date(key: str, m: str) -> str:
    """A date with slashes and the year last is read day first if that is valid; those that are valid month first only
    are permuted among themselves, as the same day may be written both ways."""
    form = f"""case when {m} like '____-%' then 'yyyy-MM-dd' when {m} like '____/%' then 'yyyy/MM/dd' when {m} like '__.%' then 'dd.MM.yyyy'
        when try_to_date({m}, 'dd/MM/yyyy') is not null then 'dd/MM/yyyy' else 'MM/dd/yyyy' end"""
    first = "make_date(1800 + 400 * cast(floor((year(d) - 1800) / 400) as int), 1, 1)"
    day = "datediff(d, y)"
    r = _feistel(key, "date", f"{day} div {DAYS[1]}", str(DAYS[0]), f"{day} % {DAYS[1]}", str(DAYS[1]))
    usual = _let(r, "f", f"date_add(y, cast(f.a * {DAYS[1]} + f.b as int))")
    rank = "datediff(d, y) - 12 * ((year(d) - year(y)) * 12 + month(d))"
    r = _feistel(key, "late", f"({rank}) div {LATE[1]}", str(LATE[0]), f"({rank}) % {LATE[1]}", str(LATE[1]))
    about = f"cast(floor(r / {LATE_OF_MONTH}) as int)"
    month = f"array_max(filter(sequence(greatest({about} - 1, 0), least({about} + 1, 4799)), k -> datediff(add_months(y, k), y) - 12 * k <= r))"
    late = _let(_let(r, "f", f"cast(f.a * {LATE[1]} + f.b as int)"), "r", _let(month, "k", "date_add(add_months(y, k), 12 + r - datediff(add_months(y, k), y) + 12 * k)"))
    new = _let(first, "y", f"date_format(if(o = 'MM/dd/yyyy', {late}, {usual}), o)")
    return _let(form, "o", _let(f"try_to_date({m}, o)", "d", f"if(year(d) between {YEARS[0]} and {YEARS[1]}, {new}, {m})"))


def _ssn(key: str, m: str) -> str:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999, permuted among themselves."""
    area, rest = "cast(substr(d, 1, 3) as int)", "(cast(substr(d, 4, 2) as int) - 1) * 9999 + cast(substr(d, 6) as int) - 1"
    r = _feistel(key, "ssn", f"if({area} > 666, {area} - 2, {area} - 1)", "898", rest, str(99 * 9999))
    new = _let(r, "f", f"concat({_pad('if(f.a >= 665, f.a + 2, f.a + 1)', '3')}, {_pad('f.b div 9999 + 1', '2')}, {_pad('f.b % 9999 + 1', '4')})")
    ok = f"{area} between 1 and 899 and {area} <> 666 and substr(d, 4, 2) <> '00' and substr(d, 6) <> '0000'"
    return _let(_digits(m), "d", f"if({ok}, {_rewritten(m, new)}, {m})")


def _phone(key: str, m: str) -> str:
    """The country code stays. North American numbers are permuted among those whose area and exchange are valid
    (200-999), those whose area is, and the others."""
    us = f"({m} rlike '^[+]1[^0-9]' or not {m} like '+%')"
    area, rest = "cast(substr(n, 1, 3) as int) - 200", "cast(substr(n, 4, 3) as int) * 10000 + cast(substr(n, 7) as int)"

    def of_area(kind: str, least: int, exchanges: int) -> str:
        r = _feistel(key, kind, area, "800", f"{rest} - {least * 10000}", str(exchanges * 10000))
        return _let(r, "f", f"concat({_pad('f.a + 200', '3')}, {_pad(f'f.b div 10000 + {least}', '3')}, {_pad('f.b % 10000', '4')})")

    r = _feistel(key, "nanp0", "cast(n as bigint) div 100000", "20000", "cast(n as bigint) % 100000", "100000")
    without = _let(r, "f", f"concat({_pad('f.a', '5')}, {_pad('f.b', '5')})")
    nanp = f"concat(substr(d, 1, length(d) - 10), case when substr(n, 1, 1) < '2' then {without} when substr(n, 4, 1) < '2' then {of_area('nanp1', 0, 200)} else {of_area('nanp', 200, 800)} end)"
    code = f"length({_digits(f"regexp_extract({m}, '^[+][0-9]{{1,3}}', 0)")})"
    other = _digits_feistel(key, "phone", "substr(d, c + 1)")
    generic = _let(f"if({m} rlike '^[+][0-9]{{1,3}}[ (-]', {code}, 0)", "c", f"concat(substr(d, 1, c), {other})")
    new = _let("right(d, 10)", "n", f"if({us} and length(d) >= 10, {nanp}, {generic})")
    return _let(_digits(m), "d", f"if(length(d) >= 8, {_rewritten(m, new)}, {m})")


def _string_feistel(key: str, kind: str, x: str, letters: int = 26) -> str:
    """Permute a string of up to 128 characters among those with the same classes at the same places. Each round moves
    the characters of one half, each within its digits or its letters, by keyed bytes of the other half."""
    by = "cast(conv(substr(z, 2 * j + 1, 2), 16, 10) as int)"
    moved = f"""array_join(transform(split(s.a, ''), (g, j) -> case when g between '0' and '9' then char(48 + (ascii(g) - 48 + {by}) % 10)
        when g between 'a' and 'z' then char(97 + (ascii(g) - 97 + {by}) % {letters}) when g between 'A' and 'Z' then char(65 + (ascii(g) - 65 + {by}) % {letters}) else g end), '')"""
    step = _let(f"sha2(concat({_quoted(f'{key}|{kind}|')}, i, '|', s.b), 512)", "z", moved)
    half = f"cast(length({x}) / 2 as int)"
    first = f"named_struct('a', substr({x}, 1, {half}), 'b', substr({x}, {half} + 1))"
    return f"aggregate(sequence(1, {ROUNDS}), {first}, (s, i) -> named_struct('a', s.b, 'b', {step}), s -> concat(s.a, s.b))"


def _email(key: str, m: str) -> str:
    """The mail name changes, the domain stays."""
    return _let(f"substring_index({m}, '@', 1)", "u", f"concat({_string_feistel(key, 'email', 'u')}, substr({m}, length(u) + 1))")


def _secret(key: str, m: str) -> str:
    """What stands after AKIA, or after = or : and its blanks and quotes."""
    head = f"""if({m} like 'AKIA%', 'AKIA', regexp_extract({m}, '^[A-Za-z_]+\\\\s*[=:]\\\\s*["\\']?', 0))"""
    return _let(head, "h", _let(f"substr({m}, length(h) + 1)", "v", f"concat(h, {_string_feistel(key, 'secret', 'v')})"))


REWRITE = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "ip6": _ip6, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


@functools.cache
def _own_key() -> str:
    return secrets.token_hex(16)


def key_of(spark: SparkSession) -> str:
    """The key that the session names in spark.sonaria.pseudonyms.key. Where it names none, a random one of this process,
    so that nobody can undo the pseudonyms, and those of another run don't link with them."""
    return spark.conf.get("spark.sonaria.pseudonyms.key", None) or _own_key()


def mask(docs: DataFrame, key: str) -> DataFrame:
    """docs with every piece of validated personal data in column text replaced by its pseudonym, and a column
    n_pii (long) that counts them.

    key: names the permutations; who knows it can undo them, so it belongs to a secret store. docs: text and any
    other columns, which stay, unless one is named n_pii. What looks like a number or
    date but is not valid stays as it is, and so do dates before the year 200 and after 9799. Texts of any length are
    read whole. A null text stays null and counts 0; texts without personal data do not change; equal values get equal
    pseudonyms in all documents and rows, different values of one format different ones; an empty table stays empty.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    case = "case " + " ".join(f"when m rlike {_quoted(f'^(?:{p})$')} then {REWRITE[k](key, 'm')}" for k, p in PATTERNS.items()) + " else m end"
    t = docs.withColumn("n_pii", F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0)))
    new = F.expr(f"transform(n_pii, m -> named_struct('old', m, 'new', {case}))")
    t = t.withColumn("n_pii", F.when(F.size("n_pii") > 0, new))
    joined = F.expr(
        f"""concat_ws('', zip_with(split(text, {_quoted(ANY)}, -1), n_pii, (gap, x) -> concat(gap, coalesce(x.new, ''))))"""
    )
    done = {c: F.col(c) for c in docs.columns if c != "n_pii"}
    done["text"] = F.when(F.col("n_pii").isNull(), F.col("text")).otherwise(joined).alias("text")
    count = F.coalesce(F.size(F.filter("n_pii", lambda x: x["old"] != x["new"])), F.lit(0))
    return t.select(*done.values(), F.greatest(count, F.lit(0)).cast("long").alias("n_pii"))
