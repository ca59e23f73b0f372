"""PII (op 1): surrogate generation, in DataFrame functions only.

Entities are found by one pattern: e-mail addresses, secrets behind a name and access keys, IBANs, IP addresses,
social security numbers, payment cards, phone numbers, and persons named with a title. A person's full name (two names
or more) is then found in the same text without a title too. Each entity consists of atoms (an address of its domain and
itself, a person of each given name and the family name, a phone number of its national digits, without country code and
leading zero) in a canonical form, so that mentions in other formats, with or without title, given name or country code,
refer to one entity everywhere in the corpus. An atom's surrogate is drawn from a keyed hash and keeps its type: classes
of characters, issuer digit and check digits, valid octets, the country of an IBAN or phone, the script of a name and its
gender, which all titles of the name in the corpus decide together. Surrogates are drawn again until no two atoms of a
kind have the same and none is an atom of the corpus itself; then they are put into the mentions in the format each
mention had, capitals included. Atoms that still collide after ROUNDS_MAX draws, as when a kind has more atoms than
surrogates, get a bracketed mark with 96 bits of the keyed hash in place of the mention.

A null text stays null with 0 entities; texts without entities stay as they are. A document is known by its id and a
hash of its text, so repeated rows get the same result. The key comes from the caller or from the setting
askloom.pii.key; without either nothing runs. Without the key nobody can draw the surrogates again; the same key gives
the same surrogates for the same corpus. Names without any title, and addresses, are not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.common import cut, held, table

SETTING = "askloom.pii.key"
#: For the registered query and the pipeline where the setting is unset, as in tests; no secret.
DEMO_KEY = "askloom-surrogates-1"
ROUNDS_MAX = 24
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 32_000_000
NO_ID = -(1 << 63)
KINDS = ("email", "secret", "iban", "ip", "ssn", "card", "phone", "person")

# fixed values: titles by gender; syllables and endings of names by script
MALE = "Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Don|Signor|господин|Господин|г-н|Г-н|κύριος|Κύριος"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Doña|Signora|госпожа|Госпожа|г-жа|Г-жа|κυρία|Κυρία"
NEUTRAL = "Dr|Prof|Professor|Doctor|Doktor|Docteur"
SCRIPTS = {
    "latin": ("ba be bo da de do fa fe ga go ha he ka ke la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve", "n r s l", "a ina", "ak ez"),
    "cyrillic": ("ба бе бо да де до ва ве га го за зе ка ке ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то", "н р с л", "а ина", "ев ин"),
    "greek": ("βα βε βο δα δε δο γα γε ζα ζε κα κε λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το φα φε", "ν ρ ς λ", "α ινα", "ης ας"),
}

# fixed values: country codes of phone numbers by their beginning
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
SECRET = r"(?<=(?i:password|passwd|pwd|secret|token|api_key|apikey|access_key)[ ]{0,2}[=:][ ]{0,2}[\"']?)(?=[^\s\"']*\d)[^\s\"'=:][^\s\"']{5,}"
ACCESS = r"(?<!\w)A[KS]IA[A-Z0-9]{16}(?!\w)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)"
SSN = r"(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)"
CARD = r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+(?=(?:[ ().-]{0,2}\d){8,15}(?!\d))\d[\d ().-]{6,20}\d(?!\w)|(?<![\w.])0\d(?:[ .-]\d{2}){4}(?!\w)"
PERSON = rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.? (?:\p{{Lu}}[\p{{L}}'-]+ ){{0,2}}\p{{Lu}}[\p{{L}}'-]*\p{{L}}"
NAME = r"\p{Lu}[\p{L}'-]*(?: \p{Lu}[\p{L}'-]*)+"
TITLE = rf"^(?:{MALE}|{FEMALE}|{NEUTRAL})\.? "
ENTITY = "|".join((EMAIL, SECRET, ACCESS, IBAN, IP, SSN, CARD, PHONE, PERSON))
TITLED = rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.? "
HINT = rf"[0-9@]|(?:{MALE}|{FEMALE}|{NEUTRAL})"
ALNUM = r"[^\p{L}\p{N}]"


def kind_of(mention: Column) -> Column:
    full = lambda p: mention.rlike(f"^(?:{p})$")
    return (
        F.when(full(EMAIL), "email").when(full(IP), "ip").when(full(ACCESS), "secret").when(full(IBAN), "iban").when(full(SSN), "ssn")
        .when(full(CARD), "card").when(full(PHONE), "phone").when(full(PERSON), "person").when(full(NAME), "person").otherwise("secret")
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def script_of(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def names_of(mention: Column) -> Column:
    """A person's names, without the title."""
    return F.split(F.regexp_replace(mention, TITLE, ""), " ")


def gender_of(mention: Column) -> Column:
    """m or f by the title, else null."""
    return F.when(mention.rlike(rf"^(?:{MALE})\.? "), "m").when(mention.rlike(rf"^(?:{FEMALE})\.? "), "f")


def national(mention: Column) -> Column:
    """A phone number's digits without country code and leading zero."""
    own = F.when(mention.startswith("+"), digits(F.regexp_replace(F.concat(F.lit("+"), digits(mention)), COUNTRY, ""))).otherwise(digits(mention))
    return F.regexp_replace(own, "^0+(?=.)", "")


def atoms_of(kind: Column, mention: Column) -> Column:
    """array of (role, sort, canon): the atoms of a mention. sort: within which surrogates are distinct."""
    one = lambda role, sort, canon: F.struct((role if isinstance(role, Column) else F.lit(role)).alias("role"), (sort if isinstance(sort, Column) else F.lit(sort)).alias("sort"), canon.alias("canon"))
    low = F.lower(mention)
    names = names_of(mention)
    sort = lambda what, name: F.concat_ws("_", F.lit(what), script_of(name))
    given = F.transform(F.slice(names, F.lit(1), F.size(names) - 1), lambda g, i: one(F.concat(F.lit("given"), i.cast("string")), sort("given", g), F.lower(g)))
    family = F.element_at(names, -1)
    person = F.concat(given, F.array(one("family", sort("family", family), F.lower(family))))
    return (
        F.when(kind == "email", F.array(one("domain", "domain", F.substring_index(low, "@", -1)), one("whole", "email", low)))
        .when(kind == "person", person)
        .when(kind == "phone", F.array(one("whole", "phone", national(mention))))
        .when(kind.isin("card", "ssn"), F.array(one("whole", kind, digits(mention))))
        .when(kind == "iban", F.array(one("whole", "iban", F.replace(mention, F.lit(" "), F.lit("")))))
        .otherwise(F.array(one("whole", kind, mention)))
    )


def stream(key: str, sort: Column, canon: Column, attempt: int) -> Column:
    """Two hexadecimal digits for each character of canon, and 64 more."""
    seed = lambda i: F.sha2(F.concat_ws("|", F.lit(key), sort, canon, F.lit(attempt), i.cast("string")), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(canon) / 32) + 1), seed), "")


def byte(s: Column, i: Column | int) -> Column:
    return F.conv(F.substring(s, (i if isinstance(i, Column) else F.lit(i)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def same_class(text: Column, s: Column) -> Column:
    """Every ASCII letter and digit drawn again within its class; hexadecimal texts stay hexadecimal."""
    hexed = text.rlike("^(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{8,}$")

    def drawn(c: Column, i: Column) -> Column:
        b = byte(s, i)
        return (
            F.when(hexed, F.lower(F.hex(b % 16))).when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(b % 26 + 97)).when(c.rlike("[A-Z]"), F.char(b % 26 + 65))
            .when(c.rlike(r"\p{L}"), F.char(b % 26 + 97)).otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), drawn), "")


def luhn(text: Column) -> Column:
    """The sum of the Luhn formula over a string of digits."""
    def one(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        twice = F.pmod(F.length(text) - i, F.lit(2)) == 0
        return F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """A string of digits and capitals, letters as 10 to 35, modulo 97."""
    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def name_like(sort: Column, gender: Column, s: Column, attempt: int) -> Column:
    """A name by syllables of the script; given names end by gender (m, f or null). Later attempts are longer."""
    count = 2 + attempt // 4
    out = None
    for script, (syllables, closers, female, male) in SCRIPTS.items():
        held_by = F.split(F.lit(syllables), " ")
        pick = lambda words, i: F.get(F.split(F.lit(words), " "), F.pmod(byte(s, i), F.size(F.split(F.lit(words), " "))))
        root = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.get(held_by, F.pmod(byte(s, i), F.size(held_by)))), "")  # noqa: B023
        made = F.when(sort.startswith("given") & (gender == "f"), F.concat(root, pick(female, 20))).when(sort.startswith("given") & (gender == "m"), F.concat(root, pick(male, 20))).otherwise(F.concat(root, pick(syllables, 21), pick(closers, 20)))
        out = F.when(sort.endswith(script), made) if out is None else out.when(sort.endswith(script), made)
    return out


def surrogate(sort: Column, canon: Column, attempt: int, key: str) -> Column:
    """The surrogate of an atom's canonical form at an attempt. Short forms may all be taken: later attempts are longer."""
    s = F.col("_s")
    more = F.concat(*[F.char(byte(s, F.length(canon) + i) % 26 + 97) for i in range(max(0, attempt - 3))]) if attempt > 3 else F.lit("")
    octet = lambda i: (byte(s, i) % 254 + 1).cast("string")
    body = F.concat(F.substring(canon, 1, 1), F.expr("substring(_again, 2, length(_again) - 2)"))
    check = lambda b: F.pmod(-luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")
    rest = F.expr("substring(_again, 5)")
    country = F.substring(canon, 1, 2)
    iban = F.concat(country, F.lpad((98 - mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0"), rest)
    return (
        F.when(sort == "email", F.concat(more, F.substring_index(F.col("_again"), "@", 1)))
        .when(sort == "domain", F.concat(more, F.expr("substring(_again, 1, length(_again) - length(substring_index(_again, '.', -1)))"), F.substring_index(canon, ".", -1)))
        .when(sort == "ip", F.concat_ws(".", (byte(s, 4) % 223 + 1).cast("string"), *[octet(i) for i in range(3)]))
        .when(sort == "phone", F.concat((byte(s, 0) % 8 + 2).cast("string"), F.expr("substring(_again, 2)")))
        .when(sort == "ssn", F.concat(F.lit("9"), F.expr("substring(_again, 2)")))
        .when((sort == "card") & (luhn(canon) % 10 == 0), F.concat(body, check(body)))
        .when(sort == "card", F.concat(F.substring(canon, 1, 1), F.expr("substring(_again, 2)")))
        .when(sort == "iban", iban)
        .when(canon.rlike("^A[KS]IA[A-Z0-9]{16}$"), F.concat(F.substring(canon, 1, 4), F.expr("substring(_again, 5)")))
        .when(sort.startswith("given") | sort.startswith("family"), name_like(sort, F.col("gender"), s, attempt))
        .otherwise(F.concat(F.col("_again"), more))
    )


def draw(atoms: DataFrame, key: str) -> DataFrame:
    """atoms (sort, canon, gender; distinct by the first two) with sur, drawn until all of a sort differ and none is an
    atom itself; what is left after ROUNDS_MAX draws gets a mark."""
    waiting, done = cut(atoms), None
    for attempt in range(ROUNDS_MAX):
        drawn = waiting.withColumn("_s", held(stream(key, F.col("sort"), F.col("canon"), attempt)))
        drawn = drawn.withColumn("_again", held(same_class(F.col("canon"), F.col("_s"))))
        drawn = drawn.select("sort", "canon", surrogate(F.col("sort"), F.col("canon"), attempt, key).alias("sur"))
        # an address is distinct by its whole: the domain's surrogate is the same for all of it, so the local part decides
        group = F.when(F.col("sort") == "email", F.substring_index("canon", "@", -1)).otherwise("")
        drawn = cut(drawn.withColumn("grp", group))
        real = F.when(F.col("sort") == "email", F.substring_index("canon", "@", 1)).otherwise(F.col("canon")).alias("sur")
        good = drawn.join(atoms.select("sort", real).distinct(), ["sort", "sur"], "left_anti")
        if done is not None:
            good = good.join(done.select("sort", "grp", "sur"), ["sort", "grp", "sur"], "left_anti")
        good = good.groupBy("sort", "grp", "sur").agg(F.min("canon").alias("canon"))
        done = cut(good if done is None else done.unionByName(good))
        waiting = cut(waiting.join(done, ["sort", "canon"], "left_anti"))
        if waiting.isEmpty():
            return done.select("sort", "canon", "sur")
    mark = F.substring(F.sha2(F.concat_ws("|", F.lit(key), "sort", "canon", F.lit("mark")), 256), 1, 24)
    return done.select("sort", "canon", "sur").unionByName(waiting.select("sort", "canon", F.concat(F.lit("["), "sort", F.lit("-"), mark, F.lit("]")).alias("sur")))


def fill(mention: Column, sur: Column, keep: str) -> Column:
    """The mention with its characters of class `keep` replaced by sur, from the right; the rest stays."""
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    own = F.length(F.regexp_replace(mention, f"[^{keep}]", ""))

    def put(c: Column, i: Column) -> Column:
        k = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), f"[^{keep}]", "")) - own + F.length(sur)
        return F.when(c.rlike(f"[{keep}]") & (k >= 0), F.substring(sur, k + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars, put), "")


def cased(name: Column, like: Column) -> Column:
    return F.when(like == F.upper(like), F.upper(name)).otherwise(F.initcap(name))


def capitals(sur: Column, like: Column) -> Column:
    """sur with capitals where `like` has them."""
    chars = F.filter(F.split(sur, ""), lambda c: c != "")
    made = F.array_join(F.transform(chars, lambda c, i: F.when(F.substring(like, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return F.when(like == F.lower(like), sur).otherwise(made)


def rendered(kind: Column, mention: Column, sur: Column) -> Column:
    """The surrogate mention; sur: map of role to surrogate."""
    whole = sur["whole"]
    names = names_of(mention)
    n = F.size(names)
    each = F.transform(names, lambda x, i: cased(sur[F.when(i == n - 1, "family").otherwise(F.concat(F.lit("given"), i.cast("string")))], x))
    person = F.concat(F.regexp_extract(mention, f"({TITLE})?", 0), F.array_join(each, " "))
    email = F.concat(capitals(whole, F.substring_index(mention, "@", 1)), F.lit("@"), capitals(sur["domain"], F.substring_index(mention, "@", -1)))
    return (
        F.when(whole.startswith("["), whole).when(kind == "email", email).when(kind == "person", person)
        .when(kind.isin("phone", "card", "ssn"), fill(mention, whole, "0-9")).when(kind == "iban", fill(mention, whole, "0-9A-Z")).otherwise(whole)
    )


def pattern_of(text: Column) -> Column:
    """The pattern of a text's entities: the common one and the full names that stand behind a title somewhere in it."""
    titled = F.filter(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)), lambda x: x.rlike(TITLE + r"\S+ "))
    names = F.array_sort(F.array_distinct(F.transform(titled, lambda x: F.regexp_replace(x, TITLE, ""))), lambda a, b: F.length(b) - F.length(a))
    full = F.concat(F.lit(ENTITY + r"|(?<![\p{L}'-])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}'-])"))
    return F.when(text.rlike(TITLED) & (F.size(names) > 0), full).otherwise(F.lit(ENTITY))


def mentions(text: Column, pattern: Column) -> Column:
    """The entities of a text in order; none where nothing hints at one."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))


def key_of(docs: DataFrame, secret: str | None) -> str:
    """The caller's key, or that of the setting; an error without either."""
    found = secret or docs.sparkSession.conf.get(SETTING, None)
    if not found:
        raise ValueError(f"surrogates need a key: give one, or set {SETTING}")
    return found


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))


def surrogates(docs: DataFrame, secret: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h, pattern, made: for each document with entities, (at, kind, new) of every mention in order."""
    secret = key_of(docs, secret)
    own = keyed(docs, key, text).withColumn("p", held(pattern_of(F.col("t")))).select("id", "h", "p", held(mentions(F.col("t"), F.col("p"))).alias("m")).where(F.size("m") > 0).distinct()
    rows = own.select("id", "h", F.when(F.col("p") != ENTITY, F.col("p")).alias("p"), F.posexplode("m").alias("at", "mention"))
    rows = rows.withColumn("kind", held(kind_of(F.col("mention"))))
    rows = cut(rows.withColumn("atoms", atoms_of(F.col("kind"), F.col("mention"))))
    flat = rows.select("id", "h", "p", "at", "kind", "mention", F.explode("atoms").alias("a")).select("id", "h", "p", "at", "kind", "mention", "a.*")
    gender = F.when(F.col("role").startswith("given"), gender_of(F.col("mention")))
    atoms = flat.groupBy("sort", "canon").agg(F.min(gender).alias("g1"), F.max(gender).alias("g2")).select("sort", "canon", F.when(F.col("g1") == F.col("g2"), F.col("g1")).alias("gender"))
    drawn = draw(atoms, secret)
    pairs = flat.join(drawn, ["sort", "canon"]).groupBy("id", "h", "p", "at", "kind", "mention").agg(F.map_from_entries(F.collect_list(F.struct("role", "sur"))).alias("sur"))
    made = pairs.select("id", "h", "p", F.struct("at", "kind", rendered(F.col("kind"), F.col("mention"), F.col("sur")).alias("new")).alias("x"))
    return cut(made.groupBy("id", "h").agg(F.first("p").alias("pattern"), F.sort_array(F.collect_list("x")).alias("made")))


def replace_entities(docs: DataFrame, secret: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row (the columns docs had), new (the text with surrogates) and made, for every row of docs."""
    made = surrogates(docs, secret, key, text)
    size = F.aggregate("made", F.lit(0), lambda a, x: a + 16 + F.length(x["new"])) + F.coalesce(F.length("pattern"), F.lit(0))
    bound = made.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("chars")).first()
    if bound["n"] <= BROADCAST_ROWS and bound["chars"] <= BROADCAST_CHARS:
        made = F.broadcast(made)
    out = keyed(docs, key, text).join(made, ["id", "h"], "left")
    between = F.when(F.col("pattern").isNull(), F.split("t", ENTITY, -1)).otherwise(F.split(F.col("t"), F.col("pattern"), -1))
    new = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get("made", i)["new"], F.lit("")))), "")
    return out.select("row", F.when(F.col("made").isNull(), F.col("t")).otherwise(new).alias("new"), F.coalesce("made", F.array().cast("array<struct<at:int,kind:string,new:string>>")).alias("made"))


def replace_documents(docs: DataFrame, secret: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with surrogates in the text column; n_chars, where there is one, follows the text."""
    out = replace_entities(docs, secret, key, text)
    size = F.length("new").cast("long")
    return out.select(*[F.col("new").alias(c) if c == text else F.coalesce(size, F.lit(0)).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_entities(table(spark, sf_dir, "documents"), spark.conf.get(SETTING, DEMO_KEY))
    count = lambda k: F.size(F.filter("made", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("row.doc_id", F.col("new").alias("text"), F.size("made").cast("long").alias("n_entities"), *[count(k) for k in KINDS])
