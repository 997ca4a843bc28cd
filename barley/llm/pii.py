"""Personal data replaced by keyed surrogates of the same type and format. DataFrame expressions only.

**Entities** are found by one pattern: mail and network addresses, phone, card and social security numbers, account numbers (IBAN), access
keys and passwords, and names behind a title. A name is a title and up to three tokens, all capitalised (also McDonald, Jean-Luc, O'Brien) or all in capitals: given
names take the title's gender (none behind Dr. or Prof.), the last token is the surname.

**Coreference.** An entity is reduced to what it refers to: letters without case for addresses and names, digits alone for numbers, account numbers without blanks. The surrogate is
drawn from a keyed hash of type and reduced form, so that one referent has one surrogate wherever and however it is written, and then laid out in
the format of each mention: separators, letter case, digits for digits, the script of names (Latin, Greek, Cyrillic), right check digits for cards and account numbers that had right ones.

**Distinctness.** The distinct referents are a table. A surrogate that two referents of a type would share, or that is itself a referent found in the
texts, is drawn again with the next attempt for all but the first referent, until none is left. The table is joined back by (type, referent).

Passwords stand after a word such as password or secret and = or :, with or without quotes and up to eight blanks around the sign; a value of mask signs
alone (********) is none. Texts without a digit, an @, a title, such a word and sign or the start of a key are passed through. The others move once, to meet the surrogates of their own entities. A referent that a third of all
texts holds is one row of the table, and its mentions are a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barley.llm.shared import stash

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
MOST_ATTEMPTS = 64

MALE = r"Mr|Herrn?|Monsieur|Señor|Don|Г-н"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Doña|Г-жа"
NEUTRAL = r"Dr|Prof|Mx"
TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE}|{NEUTRAL})\.? "
#: a name's token, capitalised or in capitals; parts follow an apostrophe, a hyphen or (McDonald) stand together
TOKEN = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}++(?:['’-]?\p{Lu}\p{Ll}*+)*+"
CAPITALS = r"(?:\p{Lu}['’]\p{Lu}|\p{Lu}\p{Lu})\p{Lu}*+(?:['’-]\p{Lu}++)*+(?!\p{L})"

#: a look-behind has a greatest length: up to eight blanks on either side of the sign
SECRET = r"(?i:password|passwd|pwd|secret)[\"']?\s{0,8}[=:]"
MASK = r"[*•.…_=-]+(?![^\s\"'])"

#: type -> pattern, tried in this order
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "password": rf"(?<=[=:\s\"'])(?<={SECRET}\s{{0,8}}[\"']?)(?!{MASK})[^\s\"']{{6,}}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{4}(?:[ -]\d{4}){3}|\d{13,19})(?![\w-])",
    "name": TITLE + f"(?:{TOKEN}(?: {TOKEN}){{0,2}}|{CAPITALS}(?: {CAPITALS}){{0,2}})",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
MAY_HOLD = rf"[0-9@]|{SECRET}|AKIA|gh[pousr]_|sk-|[a-f]{{32}}|{TITLE}"

LATIN = "ba be bo da de di fa fe ga ka ke la le li lo ma me mi na ne no pa ra re ri ro sa se ta te ti va".split()
CYRILLIC = "ба бе бо да де ди га ка ке ла ле ли ло ма ме ми на не но па ра ре ри ро са се та те ти ва ви".split()
GREEK = "βα βε γα γι δα δε ζα ζω θα κα κι κο λα λε λι μα με μι να νε νι πα πε ρα ρι ρο σα σο τα τε".split()


def replace_pii(df: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``df`` with the entities of its text replaced, all other columns as they are, and a last column ``pii`` (array of type and surrogate, in order).

    The same ``key`` gives the same surrogates for the same set of referents. Null texts stay null and have a null ``pii``; texts without entities have an
    empty one. Ids are not read: rows with equal texts are treated alike. Columns may have any names; an existing column ``pii`` is replaced.
    """
    rows = df.drop("pii").select(F.struct(*[F.col(f"`{c}`") for c in df.drop("pii").columns]).alias("row"), F.col(f"`{text_column}`").cast("string").alias("text"))
    holds = F.coalesce(F.rlike("text", F.lit(MAY_HOLD)), F.lit(False))
    marked = rows.where(holds).select("row", "text", F.xxhash64("text").alias("rk"), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("found"))
    referents = F.array_distinct(F.flatten(F.transform("found", _referents)))
    held = stash(marked.select("rk", F.explode(referents).alias("r")).select("rk", "r.type", "r.referent").distinct(), "referents")
    table = surrogates(held.select("type", "referent").distinct(), key)
    pair = F.struct(F.concat_ws("|", "type", "referent").alias("k"), F.col("surrogate").alias("v"))
    maps = held.join(table, ["type", "referent"]).groupBy("rk").agg(F.map_from_entries(F.collect_list(pair)).alias("names"))
    done = marked.join(maps, "rk", "left")
    new = F.transform("found", lambda e: F.struct(_type_of(e).alias("type"), _written(e).alias("surrogate")))
    parts = F.split("text", ENTITY, -1)
    text = F.array_join(F.zip_with(parts, F.concat(F.transform("pii", lambda p: p["surrogate"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    done = done.withColumn("pii", F.when(F.size("found") > 0, new).otherwise(F.array().cast(PII))).select("row", F.when(F.size("found") > 0, text).otherwise(F.col("text")).alias("text"), "pii")
    rest = rows.where(~holds).select("row", "text", F.when(F.col("text").isNotNull(), F.array().cast(PII)).alias("pii"))
    out = rest.unionByName(done)
    return out.select(*[F.col("text").alias(c) if c == text_column else F.col(f"row.`{c}`") for c in df.drop("pii").columns], "pii")


PII = "array<struct<type:string,surrogate:string>>"


def _type_of(e: Column) -> Column:
    """The type of an entity, by its own form; the order is that of the patterns."""
    digits = F.regexp_replace(e, r"[^0-9]", "")
    return (F.when(F.rlike(e, F.lit(f"^(?:{PATTERNS['name']})$")), F.lit("name"))
            .when(F.rlike(e, F.lit(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")), F.lit("email"))
            .when(F.rlike(e, F.lit(f"^{PATTERNS['key']}$")) & F.rlike(e, F.lit("[A-Za-z]")), F.lit("key"))
            .when(F.rlike(e, F.lit(f"^{PATTERNS['iban']}$")), F.lit("iban"))
            .when(F.rlike(e, F.lit(f"^{PATTERNS['ip']}$")), F.lit("ip"))
            .when(F.rlike(e, F.lit(f"^{PATTERNS['phone']}$")), F.lit("phone"))
            .when(F.rlike(e, F.lit(f"^{PATTERNS['ssn']}$")), F.lit("ssn"))
            .when(F.rlike(e, F.lit(f"^{PATTERNS['card']}$")) & (F.length(digits) > 12), F.lit("card"))
            .otherwise(F.lit("password")))


def _tokens(e: Column) -> Column:
    return F.split(F.regexp_replace(e, TITLE, ""), " ")


def _gender(e: Column) -> Column:
    return (F.when(F.rlike(e, F.lit(rf"^(?:{MALE})\.? ")), F.lit("given_m")).when(F.rlike(e, F.lit(rf"^(?:{FEMALE})\.? ")), F.lit("given_f"))
            .otherwise(F.lit("given")))


def _plain(e: Column) -> Column:
    """What an entity that is no name refers to."""
    kind = _type_of(e)
    return (F.when(kind == "email", F.lower(e)).when(kind == "ip", F.regexp_replace(e, r"(?<![0-9])0+(?=[0-9])", ""))
            .when(kind == "phone", F.concat(F.when(e.startswith("+"), F.lit("+")).otherwise(F.lit("")), F.regexp_replace(e, "[^0-9]", "")))
            .when(kind.isin("card", "ssn"), F.regexp_replace(e, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(e, " ", "")).otherwise(e))


def _token_types(e: Column) -> Column:
    n = F.size(_tokens(e))
    return F.transform(_tokens(e), lambda t, i: F.struct(F.when(i == n - 1, F.lit("surname")).otherwise(_gender(e)).alias("type"), F.lower(t).alias("referent"), t.alias("token")))


def _referents(e: Column) -> Column:
    return F.when(_type_of(e) == "name", F.transform(_token_types(e), lambda t: F.struct(t["type"].alias("type"), t["referent"].alias("referent")))).otherwise(F.array(F.struct(_type_of(e).alias("type"), _plain(e).alias("referent"))))


def _written(e: Column) -> Column:
    """The surrogate of an entity, laid out as the entity is."""
    kind = _type_of(e)
    own = F.element_at("names", F.concat_ws("|", kind, _plain(e)))

    def token(t: Column) -> Column:
        new = F.element_at("names", F.concat_ws("|", t["type"], t["referent"]))
        return F.when(t["token"] == F.upper(t["token"]), F.upper(new)).otherwise(F.initcap(new))
    name = F.concat(F.regexp_extract(e, rf"^({TITLE})", 1), F.array_join(F.transform(_token_types(e), token), " "))

    def laid(signs: str) -> Column:
        """The surrogate's ``signs``, one by one, where the mention has such."""
        new = F.regexp_replace(own, f"[^{signs}]", "")
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), lambda i: F.when(
            F.rlike(F.substring(e, i, F.lit(1)), F.lit(f"[{signs}]")),
            F.substring(new, F.length(F.regexp_replace(F.substring(e, F.lit(1), i), f"[^{signs}]", "")), F.lit(1))).otherwise(F.substring(e, i, F.lit(1)))), "")
    cased = F.when(e == F.upper(e), F.upper(own)).otherwise(own)
    return F.when(kind == "name", name).when(kind.isin("phone", "card", "ssn"), laid("0-9")).when(kind == "iban", laid("A-Z0-9")).when(kind == "email", cased).otherwise(own)


def surrogates(referents: DataFrame, key: str) -> DataFrame:
    """(type, referent, surrogate) with surrogates distinct within a type and none of them a referent. ``referents`` has distinct rows.

    An error, and no result, if a referent finds no free surrogate in ``MOST_ATTEMPTS`` draws: its format is used up.
    """
    known = stash(referents, "known")
    taken = known.select("type", F.col("referent").alias("surrogate"))
    waiting, done = known, None
    for attempt in range(MOST_ATTEMPTS):
        drawn = stash(waiting.withColumn("surrogate", _draw(F.col("type"), F.col("referent"), key, attempt)), "drawn")
        firsts = drawn.groupBy("type", "surrogate").agg(F.min("referent").alias("referent"))
        if done is not None:
            firsts = firsts.join(done.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        firsts = stash(firsts.join(taken, ["type", "surrogate"], "left_anti").select("type", "referent", "surrogate"), "firsts")
        done = firsts if done is None else done.unionByName(firsts)
        waiting = drawn.join(firsts, ["type", "referent"], "left_anti").select("type", "referent")
        if waiting.isEmpty():
            return done
    raise ValueError(f"after {MOST_ATTEMPTS} draws some referents have no surrogate of their own")


def _draw(kind: Column, referent: Column, key: str, attempt: int) -> Column:
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, referent, F.lit(str(attempt))), 256)

    def pick(alphabet: str, i: Column) -> Column:
        return F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(seed, i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))

    def number(i: Column, low: int, high: int) -> Column:
        return (F.pmod(F.xxhash64(seed, i), F.lit(high - low + 1)) + low).cast("string")

    def like(text: Column, kept: Column | int = 0) -> Column:
        """Letter for letter and digit for digit; the first ``kept`` signs stay."""
        # of other letters and signs alone, a password would be its own surrogate in every draw
        foreign = (kind == "password") & (F.length(F.regexp_replace(text, "[^0-9A-Za-z]", "")) < 6)
        hexadecimal = F.rlike(text, F.lit("^(?=.*[a-f])[0-9a-f]+$"))

        def one(i: Column) -> Column:
            c = F.substring(text, i, F.lit(1))
            return (F.when(i <= kept, c).when(hexadecimal, pick(HEX, i)).when(F.rlike(c, F.lit("[0-9]")), pick(DIGITS, i))
                    .when(F.rlike(c, F.lit("[a-z]")), pick(LOWER, i)).when(F.rlike(c, F.lit("[A-Z]")), pick(UPPER, i))
                    .when(foreign, pick(LOWER, i)).otherwise(c))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")

    top = F.regexp_extract(referent, r"(\.[^.]*)$", 1)   # the last label of a mail address stays
    email = F.concat(like(F.expr("substring(referent, 1, length(referent) - length(regexp_extract(referent, '([.][^.]*)$', 1)))")), top)
    ip = F.concat_ws(".", number(F.lit(1), 1, 223), *[number(F.lit(i), 0, 255) for i in (2, 3, 4)])
    card = like(referent, 1)
    card = F.when(_luhn(referent) == 0, F.concat(F.expr("''"), _with_check(card))).otherwise(card)
    iban = like(referent, 4)
    iban = F.when(_iban_rest(referent) == 1, _with_iban_check(iban)).otherwise(iban)
    prefix = F.length(F.regexp_extract(referent, "^(AKIA|gh[pousr]_|sk-)", 1))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", like(referent, F.when(referent.startswith("+"), 2).otherwise(0)))
            .when(kind == "card", card).when(kind == "key", like(referent, prefix)).when(kind == "iban", iban)
            .when(kind.isin("surname", "given_m", "given_f", "given"), _name(kind, referent, seed)).otherwise(like(referent)))


def _luhn(digits: Column) -> Column:
    """The check sum of a card number; 0 if the last digit is right."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).try_cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, b: a + b) % 10


def _with_check(digits: Column) -> Column:
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))


def _iban_rest(iban: Column) -> Column:
    """An account number modulo 97, as its check asks: the first four signs last, letters as 10 to 35; 1 if the check digits are right."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def _with_iban_check(iban: Column) -> Column:
    country, body = F.substring(iban, F.lit(1), F.lit(2)), F.substring(iban, F.lit(5), F.length(iban))
    return F.concat(country, F.lpad((98 - _iban_rest(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0"), body)


def _name(kind: Column, referent: Column, seed: Column) -> Column:
    """Three or four syllables of the referent's script, in small letters; given names end in the gender's way, if the title tells it."""
    def made(syllables: list[str], male: str, female: str) -> Column:
        one = [F.element_at(F.array(*map(F.lit, syllables)), (F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(len(syllables))) + 1).cast("int")) for i in range(4)]
        end = F.when(kind == "given_m", F.lit(male)).when(kind == "given_f", F.lit(female)).otherwise(one[3])
        return F.concat(*one[:3], end)
    return F.when(F.rlike(referent, F.lit(r"\p{IsCyrillic}")), made(CYRILLIC, "н", "я")).when(F.rlike(referent, F.lit(r"\p{IsGreek}")), made(GREEK, "ς", "α")).otherwise(made(LATIN, "n", "ia"))


def op3_pii(spark: SparkSession, sf: str, key: str = "barley") -> DataFrame:
    done = replace_pii(spark.read.parquet(f"{sf}/documents.parquet"), key)
    return done.select("doc_id", "text", F.coalesce(F.size("pii"), F.lit(0)).cast("bigint").alias("n_entities"),
                       F.array_join(F.transform("pii", lambda p: p["type"]), ",").alias("types"))
