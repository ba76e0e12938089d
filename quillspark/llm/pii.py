"""Surrogates for personal data, with built-in DataFrame functions alone.

Detected entities (e-mail, phone, card, IPv4, IPv6, IBAN, US social-security number, titled person names,
access keys and tokens, secrets in assignments) are replaced by keyed surrogates of the same type and format: digits
stay digits, letters keep case and script, punctuation and length stay, a card keeps its issuer and
a right check digit, IPv4 octets stay in range, names keep title and the ending that marks
grammatical gender, and alternate consonants and vowels as before.  A number of a card's length counts as
a card only if it has an issuer's first digits and a right check digit; others are order numbers and the like and stay.

A surrogate is a keyed permutation of all entities of its format: a Feistel network P over the letters and
digits, used as inverse(P) after adding one after P.  So no joint table is needed and, across the whole
corpus, equal entities get equal surrogates (coreference; letter case and punctuation don't matter),
different entities of a format different ones (distinctness), and no entity is its own surrogate.  Names are
permuted by part, so a person's full and short name keep the part that they share.
Each text is checked as well: ``n_collisions`` counts differences between the numbers of distinct entities
and distinct surrogates and surrogates equal to another entity of the text.  The key stays the same for all texts, as another would
give the text's entities other surrogates than elsewhere, so such texts are reported and not changed further.

Edge cases: null texts stay null and count no entities; a text without entities is unchanged; letters of
scripts without a listed alphabet are unchanged; repeated rows are redacted alike; an empty table gives no
rows; other columns aren't touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.work import fresh

KEY = "quillspark-surrogates"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A local part has 64 characters at most and doesn't begin inside a run of letters and digits, so a run of any length is read once.
_EMAIL = r"(?<![\p{L}0-9])[\p{L}0-9][\p{L}0-9._%+-]{0,63}@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)+"
#: What keys and tokens of known issuers begin with; it stays.
_KEY_START = r"(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|AIza|sk-|eyJ)"
_KEY = r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)(?![A-Za-z0-9_-])"
_HEXES = "[0-9a-fA-F]{1,4}"
#: Eight groups, or fewer with one gap; a digit tells an address with a gap from names in program text.
_IPV6 = rf"(?<![0-9A-Za-z:.])(?:(?:{_HEXES}:){{7}}{_HEXES}|(?=[a-fA-F:]*[0-9])(?:(?:{_HEXES}:){{1,6}}(?::{_HEXES}){{1,6}}|(?:{_HEXES}:){{1,7}}:|:(?::{_HEXES}){{1,7}}))(?![0-9A-Za-z:]|\.[0-9])"
_IPV4 = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: North American; then national forms that begin with 0: five pairs, or an area code and 5 to 8 digits.
_NATIONAL = r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])|(?<![0-9.+/-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9]|[.-][0-9])|(?<![0-9.+/-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8}(?![0-9]|[./-][0-9])"
#: Cards as they are printed: unbroken, or in groups of 4-4-4-4, 4-6-5, 4-6-4, and of 4-4-4-4-3 for issuers of 19 digits, with one separator.
_PRINTED = "[0-9]{13,19}|" + "|".join(rf"(?:6[0-9]|5[0678])[0-9]{{2}}(?:{s}[0-9]{{4}}){{3}}{s}[0-9]{{3}}|[0-9]{{4}}(?:{s}[0-9]{{4}}){{3}}|[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{4,5}}" for s in " -")
_CARD = rf"(?<![0-9])(?:{_PRINTED})(?![0-9])"
_OTHER = f"{_EMAIL}|{_KEY}|{_IPV6}|{_IPV4}|{_SSN}"
_MORE = "[ .()-]{0,2}[0-9]"


def _long_distance(first_gap: str) -> str:
    """An international number of 6 to 15 digits, of which two groups follow ``first_gap`` and others a separator after which no entity begins."""
    gap = rf"(?:[ .-](?!{_OTHER}|{_CARD}|{_NATIONAL})|)"
    digits = rf"(?<=\+[0-9]{_MORE * 5}{f'(?:{_MORE}' * 9}{')?' * 9})"
    return rf"\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:{first_gap}[0-9]{{2,4}}){{2}}(?:{gap}[0-9]{{2,4}}){{0,2}}(?![0-9]|\.[0-9]){digits}"


#: A number of the North American plan ends after 3 + 3 + 4 digits; groups of a phone and of a card that follows may together look like a card.
_INTERNATIONAL = "|".join(
    [
        r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
        _long_distance(rf"(?:[ .-](?!{_OTHER}|{_CARD})|)"),
        _long_distance(rf"(?:[ .-](?!{_OTHER}|[0-9]{{13,19}}(?![0-9]))|)"),
    ]
)
_TITLES = "(?:Mrs?\\.|Ms\\.|Dr\\.|Prof\\.|Herr|Frau|Mme|Mlle|Sra?\\.|Señora?|Г-н|Г-жа|Господин|Госпожа)"
_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:['’]\p{Ll}+)?"
#: In order of precedence at a place of the text.
PATTERNS = {
    "email": _EMAIL,
    "secret": r"(?<=[=:]\s{0,2}[\"']?)(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9+/_-]{8,}",
    "key": _KEY,
    "iban": rf"\b[A-Z]{{2}}[0-9]{{2}}(?:(?: (?!{_OTHER}|{_NATIONAL})|)[A-Z0-9]{{4}}){{3,7}}(?:(?: (?!{_OTHER}|{_NATIONAL})|)[A-Z0-9]{{1,3}})?\b",
    "ipv6": _IPV6,
    "ipv4": _IPV4,
    "phone": f"{_INTERNATIONAL}|{_NATIONAL}",
    "ssn": _SSN,
    "card": rf"(?=[0-9])(?:{_CARD}|(?<![0-9])[0-9](?:(?:[ -](?!{_OTHER}|{_CARD}|{_NATIONAL})|)[0-9]){{12,18}}(?![0-9]|\.[0-9]))",
    "person": rf"(?<![\p{{L}}0-9]){_TITLES}\s{_NAME}(?:[ -]{_NAME}){{0,2}}",
}
#: None of them begins at an ASCII letter after an ASCII letter or digit, which is soon seen.
ANY = "(?!(?<=[A-Za-z0-9])[A-Za-z])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Characters put around each match, so that one pass over a text finds and parts it; a text that has one of them is read twice.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
#: A cheap test that every text with an entity passes.
_MAYBE = rf"[0-9@]|::|{_TITLES}|{_KEY_START}|(?i:password|passwd|pwd|secret|token|api[_-]?key)"
_DIGITS, _HEX, _LETTERS = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
_ALPHABETS = [_DIGITS, _LETTERS, "àâäáãåçèéêëìîïíñòôöóõùûüúýÿßœæ", "αβγδεζηθικλμνοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
_NAME_ALPHABETS = [_DIGITS, "aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáãåèéêëìîïíòôöóõùûüú", "çñ", *_ALPHABETS[3:]]
#: First and last letters of runs of letters: Armenian, Hebrew, Arabic, Devanagari, Thai, Georgian, Hiragana, Katakana, Han, Hangul.
_RUNS = [(0x561, 0x586), (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10FA), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
_MORE_ALPHABETS = ["".join(map(chr, range(a, z + 1))) for a, z in _RUNS]
ROUNDS = 4
_TITLE = rf"^{_TITLES}\s"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def kind_of(entity: Column) -> Column:
    """The kind of a match; "number" for one of a card's form that is none."""
    out = F.when(entity.rlike(_TITLE), "person").otherwise("secret")
    for kind, pattern in reversed(PATTERNS.items()):
        if kind not in ("person", "secret", "card"):
            out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
        elif kind == "card":
            out = F.when(entity.rlike(f"^(?:{pattern})$"), F.when(_is_card(entity), kind).otherwise("number")).otherwise(out)
    return out


def _is_card(entity: Column) -> Column:
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return digits.rlike("^(?:2[2-7]|3[04-9]|4|5[0-9]|6[0-9])") & (_luhn_check(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1).cast("int"))


def _moved(c: Column, by: Column, alphabets: Column) -> Column:
    """The character ``by`` places on in its alphabet; one without an alphabet stays."""
    inside = lambda a: F.substring(a, F.pmod(F.instr(a, c) - 1 + by, F.length(a)) + 1, F.lit(1))
    return let(F.element_at(F.filter(alphabets, lambda a: F.contains(a, c)), 1), lambda a: F.coalesce(inside(a), c))


def _turns(state: Column, turns: list[int], sign: int, key: Column, alphabets: Column) -> Column:
    """Feistel turns: (left, right) becomes (right, left moved by a hash of key, turn and right)."""

    def turn(s: Column, t: Column) -> Column:
        by = lambda h, i: F.conv(F.substring(h, F.pmod(i * 2, F.lit(128)) + 1, F.lit(2)), 16, 10).cast("int") * sign
        half = lambda h: F.array_join(F.transform(_chars(s["l"]), lambda c, i: _moved(c, by(h, i), alphabets)), "")
        return F.struct(s["r"].alias("l"), let(F.sha2(F.concat_ws("|", key, t, s["r"]).cast("binary"), 512), half).alias("r"))

    return F.aggregate(F.array(*map(F.lit, turns)), state, turn)


def permuted(plain: Column, key: Column, alphabets: Column) -> Column:
    """inverse(P)(P(plain) + 1) for the keyed Feistel network P over the halves of ``plain``; never ``plain`` itself."""
    middle = lambda s: F.ceil(F.length(s) / 2).cast("int")
    halves = lambda s: F.struct(F.substring(s, F.lit(1), middle(s)).alias("l"), F.substr(s, middle(s) + 1).alias("r"))
    one_on = lambda x: F.concat(_moved(F.substring(x, 1, 1), F.lit(1), alphabets), F.substr(x, F.lit(2)))
    forward = lambda s: _turns(halves(s), [*range(ROUNDS)], 1, key, alphabets)
    swapped = lambda x: F.struct(x["r"].alias("l"), one_on(x["l"]).alias("r"))
    back = lambda s: let(forward(s), lambda x: _turns(swapped(x), [*range(ROUNDS)][::-1], -1, key, alphabets))
    return let(plain, lambda s: let(back(s), lambda x: F.concat(x["r"], x["l"])))


def _luhn_check(digits: Column) -> Column:
    """The check digit for a number: from the right, every other digit doubled and its digits added."""
    doubled = lambda n: n * 2 - F.when(n > 4, 9).otherwise(0)
    parts = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(parts, F.lit(0), lambda a, x: a + x), F.lit(10))


def _first_kept(e: Column, kind: Column) -> Column:
    """How many characters at the start of the entity stay."""
    country = F.length(F.regexp_extract(e, r"^\+[0-9]{1,3}(?=[ .(-])|^\+[0-9]|^0(?=[0-9])", 0))
    issuer = F.length(F.regexp_extract(e, "^4|^[0-9] ?-?[0-9]", 0))
    return F.when(kind == "key", F.length(F.regexp_extract(e, f"^{_KEY_START}", 0))).when(kind == "iban", 2).when(kind == "card", issuer).when(kind == "phone", country).otherwise(0)


def _last_changed(e: Column, kind: Column) -> Column:
    """The number of characters up to the last that may change."""
    return F.length(e) - F.when(kind == "email", F.length(F.regexp_extract(e, r"\.[^.]*$", 0))).when(kind.isin("card", "person"), 1).otherwise(0)


def surrogate(entity: Column, kind: Column, secret: Column) -> Column:
    """The replacement of one detected entity."""
    as_hex = lambda e: F.array_join(F.transform(F.split(e, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")
    as_octets = lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10)), ".")

    def changed(e: Column, kind: Column, alphabets: Column) -> Column:
        """Letters and digits in the open places are permuted; case and all other characters stay where they are."""
        open_at = lambda c, i, x: (i >= x["a"]) & (i < x["z"]) & F.exists(alphabets, lambda a: F.contains(a, F.lower(c)))
        flagged = lambda x: F.transform(x["c"], lambda c, i: F.struct(c.alias("c"), open_at(c, i, x).alias("o")))
        plain = lambda f: F.lower(F.array_join(F.transform(F.filter(f, lambda x: x["o"]), lambda x: x["c"]), ""))

        def put_back(f: Column, new: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                one = F.substring(new, acc["n"] + 1, F.lit(1))
                cased = F.when(x["c"] != F.lower(x["c"]), F.upper(one)).otherwise(one)
                return F.struct((acc["n"] + x["o"].cast("int")).alias("n"), F.concat(acc["s"], F.when(x["o"], cased).otherwise(x["c"])).alias("s"))

            return F.aggregate(f, F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), step, lambda acc: acc["s"])

        places = F.struct(_chars(e).alias("c"), _first_kept(e, kind).alias("a"), _last_changed(e, kind).alias("z"))
        return let(places, lambda x: let(flagged(x), lambda f: let(permuted(plain(f), F.concat_ws("|", secret, kind), alphabets), lambda new: put_back(f, new))))

    def named(e: Column, alphabets: Column) -> Column:
        """Title and everything but letters stay; each part of the name is permuted for itself, but for its last letter."""
        parts = F.regexp_extract_all(F.regexp_replace(e, _TITLE, ""), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
        one = lambda p: F.when(p.rlike(r"^\p{L}{2}"), changed(p, F.lit("person"), alphabets)).otherwise(p)
        return F.concat(F.regexp_extract(e, _TITLE, 0), F.array_join(F.transform(parts, one), ""))

    def rechecked(new: Column) -> Column:
        """A card with the check digit that its new digits need."""
        digits = F.regexp_replace(new, "[^0-9]", "")
        return F.concat(F.substring(new, F.lit(1), F.length(new) - 1), _luhn_check(F.substring(digits, F.lit(1), F.length(digits) - 1)).cast("string"))

    listed = lambda *tables: F.array(*(F.lit(a) for t in tables for a in t))
    other_script = lambda e: e.rlike(r"[\p{L}&&[^\p{IsLatin}\p{IsGreek}\p{IsCyrillic}]]")
    table = lambda e, kind: F.when(kind.isin("ipv4", "ipv6"), listed([_HEX])).when(kind == "person", F.when(other_script(e), listed(_NAME_ALPHABETS, _MORE_ALPHABETS)).otherwise(listed(_NAME_ALPHABETS))).when(other_script(e), listed(_ALPHABETS, _MORE_ALPHABETS)).otherwise(listed(_ALPHABETS))
    form = lambda e, kind: F.when(kind == "ipv4", as_hex(e)).otherwise(e)
    done = lambda kind, new: F.when(kind == "ipv4", as_octets(new)).when(kind == "card", rechecked(new)).otherwise(new)
    plain = lambda e, kind, a: let(changed(form(e, kind), kind, a), lambda new: done(kind, new))
    return let(entity, lambda e: let(kind, lambda k: let(table(e, k), lambda a: F.when(k == "person", named(e, a)).otherwise(plain(e, k, a)))))


def redacted(docs: DataFrame, secret: str = KEY, entities: str = "_entities", collisions: str = "_collisions") -> DataFrame:
    """``docs`` with surrogates in text, and the numbers of a text's entities and collisions in columns of these names."""
    found, new = fresh(docs, "found"), fresh(docs, "new")
    parts = fresh(docs, "parts")
    text, none = F.col("text"), F.array().cast("array<string>")
    once = F.split(F.regexp_replace(text, f"({ANY})", f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]")
    every = lambda x, first: F.transform(F.sequence(F.lit(first), F.size(x), F.lit(2)), lambda i: F.element_at(x, i))
    marked = F.when(text.rlike(f"[{_OPEN}{_CLOSE}]"), F.struct(F.split(text, ANY).alias("rest"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("found")))
    marked = marked.otherwise(let(once, lambda x: F.struct(every(x, 1).alias("rest"), F.when(F.size(x) > 1, every(x, 2)).otherwise(none).alias("found"))))
    docs_parted = docs.withColumn(parts, F.when(text.rlike(_MAYBE), marked))
    matches = F.coalesce(F.col(parts)["found"], none)
    with_kinds = F.transform(matches, lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    secrets = F.regexp_extract_all(text, F.lit(PATTERNS["secret"]), F.lit(0))
    # a number in an assignment is a secret; only then are assignments looked up again
    told = lambda pairs: F.when(F.exists(pairs, lambda x: x["kind"] == "number"), let(secrets, lambda s: F.transform(pairs, lambda x: F.struct(x["e"].alias("e"), F.when((x["kind"] == "number") & F.array_contains(s, x["e"]), "secret").otherwise(x["kind"]).alias("kind"))))).otherwise(pairs)
    out = docs_parted.withColumn(found, let(with_kinds, told))
    key = F.lit(secret)
    out = out.withColumn(new, F.transform(found, lambda x: F.when(x["kind"] == "number", x["e"]).otherwise(surrogate(x["e"], x["kind"], key))))
    real = F.transform(F.filter(found, lambda x: x["kind"] != "number"), lambda x: x["e"])
    differ = lambda old, made: F.abs(F.size(F.array_distinct(old)) - F.size(F.array_distinct(made))) + F.size(F.array_intersect(made, old))
    replaced = F.filter(new, lambda _, i: F.get(F.col(found), i)["kind"] != "number")
    counted = out.withColumn(entities, F.size(real).cast("long")).withColumn(collisions, differ(real, replaced).cast("long"))
    joined = let(F.col(parts)["rest"], lambda p: F.concat(F.array_join(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.col(new), lambda a, b: F.concat(a, b)), ""), F.element_at(p, -1)))
    return counted.withColumn("text", F.when(F.col(entities) > 0, joined).otherwise(text)).drop(found, new, parts)


def without_pii(docs: DataFrame) -> DataFrame:
    """The documents with surrogates, with their own columns; n_chars follows the text."""
    entities, collisions = fresh(docs, "entities"), fresh(docs, "collisions")
    out = redacted(docs, entities=entities, collisions=collisions)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(entities) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return redacted(docs).select("doc_id", "text", F.col("_entities").alias("n_entities"), F.col("_collisions").alias("n_collisions"))
