"""PII surrogates in DataFrame functions only: keyed, type-consistent, distinct and coreferent.

Detection is one regular expression over whole texts: e-mail and IPv4 addresses, phone, card and
social security numbers (16 digits that fail the Luhn test are an account number, and stay so; other such digits are nothing), access keys, values after token/password/secret/api key, and names after one or more
titles. A person named once with a title is hidden in the whole text: every other word of it that is one of its own
surnames or given names, written with a capital, gets the same surrogate. A mention is reduced to one or two entities (type, canonical form): an e-mail in lower case,
the last ten digits of a phone number, all digits of a card, the surname and, apart, the given name
with the gender that the titles tell (some tell none). Equal entities get equal surrogates in the whole table, however
they are written.

A surrogate comes from SHA-512 of (key, type, canonical form, attempt): digits for digits, letters of
the same script and case for letters, issuer digit and check digit of cards, name syllables
of the same script and given names of the same gender. Collision check: within a type no two
entities may share a surrogate and no surrogate may equal an entity that occurs; offenders go to the
next attempt until none is left. All but the least canonical form of a clash move. Names get longer
with each attempt, all other surrogates from attempt WIDEN on, so that the rounds end however small the
space of a form is. Letters keep to the Latin, Cyrillic, Greek, Hebrew, Arabic and Devanagari scripts, names to the
first three; letters of others become Latin.

Only texts with mentions go through the shuffles of the entity tables; all others pass unchanged.

Edge cases: null and empty texts and texts without mentions are returned as they are; repeated rows
get equal texts; null ids do not matter; columns keep their names and order, n_chars, if there is one
of type bigint, follows a changed text; an empty table gives an empty one.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistrack.session import cut, stored

#: Titles that tell a gender; kept in the text as they are.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа")
#: Titles that tell none.
NEUTRAL = ("Dr", "Prof", "Doctor", "Professor", "Dra")
TITLE = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
TITLES = rf"(?:(?:{TITLE})\.? )+"
#: Given names for surrogates by gender and script.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Lukas Martin Nils Oskar Paul".split(),
    ("f", "latin"): "Anna Berta Clara Diana Elena Flora Greta Helen Irene Julia Karla Laura Maria Nina Olga Paula".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Ксения Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    ("m", "greek"): "Αντώνης Βασίλης Γιάννης Δημήτρης Ηλίας Θωμάς Κώστας Λευτέρης Μάρκος Νίκος Πέτρος Ρήγας Σπύρος Στέλιος Τάσος Χρήστος".split(),
    ("f", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Θεοδώρα Ιωάννα Κατερίνα Μαρία Νίκη Ξένια Ράνια Σοφία Φωτεινή Χριστίνα".split(),
    ("n", "latin"): "Alex Andy Charlie Chris Dana Eden Jamie Jules Kim Lou Max Nico Pat Robin Sam Toni".split(),
}
#: Without a gender, the other scripts take the first list.
GIVEN |= {("n", s): GIVEN["m", s] for s in ("cyrillic", "greek")}
SYLLABLES = {"latin": "bar den fos gal hel jor kam lin mor nes pal ros sel tor ven wil".split(), "cyrillic": "бар вен гор дол зар кам лен мор нев пол рос сел тор фен хар шел".split(), "greek": "βαρ δεν φος γαλ κελ τζορ καμ λιν μορ νες παλ ρος σελ τορ βεν φιλ".split()}
#: Letters that stand for letters of a script.
ALPHABETS = {
    "Cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "Devanagari": "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह", "Latin": "abcdefghijklmnopqrstuvwxyz",
}
#: Words of a text: what names can stand in, and the ends of such words.
WORD_ENDS = r"(?<=[\p{L}\p{M}'-])(?=[^\p{L}\p{M}'-])|(?<=[^\p{L}\p{M}'-])(?=[\p{L}\p{M}'-])"

#: The key of tests and checks.
TEST_KEY = "public-test-key"
#: Attempts within the form of an entity; each later one adds a character.
WIDEN = 4

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PHONES = (r"(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}", r"\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}")
PHONE = "|".join(PHONES)
#: Its only group is the value after token, password, secret or api key.
PATTERN = "|".join((
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"""(?:(?<=[="':])|(?<=[=:] ))(?<=(?i:token|password|passwd|pwd|secret|api[_-]?key)\s{0,2}[=:]\s{0,2}["']?)((?=[/+_-]*[A-Za-z0-9])[A-Za-z0-9/+_-]{8,})""",
    rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    rf"(?<![\d+])(?:{PHONES[0]})(?!\d)",
    rf"(?<!\d)(?:{PHONES[1]})(?!\d)",
    r"(?<![\d.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\d])",
    rf"\b{TITLES}(?:\p{{Lu}}[\p{{L}}\p{{M}}'-]+ )?\p{{Lu}}[\p{{L}}\p{{M}}'-]+",
))
#: A text without any of these has no mention.
HINT = rf"[0-9@]|(?i:token|passw|pwd|secret|api)|(?:{TITLE})\.? "


def kind_of(m: Column, secret: Column | None = None) -> Column:
    """The kind of a mention; secret tells that it stood after a word like password. Digits in the form
    of a card that fail the Luhn test are a secret there; elsewhere 16 of them are an account number, any
    other number of them (times, book numbers) is nothing (kind none)."""
    card = F.when(_sound(_digits(m)), "card").when(F.coalesce(secret, F.lit(False)) if secret is not None else F.lit(False), "secret").when(F.length(_digits(m)) == 16, "account").otherwise("none")
    return (F.when(m.contains("@"), "email").when(m.rlike(r"^AKIA[0-9A-Z]{16}$"), "access_key").when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(r"^\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}$|^\d{13,19}$"), card)
            .when(m.rlike(rf"^(?:{PHONE})$"), "phone").when(m.rlike(rf"^{TITLES}\p{{Lu}}"), "name").otherwise("secret"))


def _bind(value: Column, use) -> Column:
    """use(value) with value written once, however often it is used: plans of nested mentions stay small."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _surname(m: Column) -> Column:
    return F.lower(F.substring_index(m, " ", -1))


def _titles(m: Column) -> Column:
    return F.regexp_extract(m, f"^{TITLES}", 0)


def _given_kind(m: Column) -> Column:
    tells = lambda titles: F.concat(F.lit(" "), _titles(m)).rlike(rf" (?:{'|'.join(titles)})\.? ")
    return F.concat(F.lit("given_"), F.when(tells(FEMALE), "f").when(tells(MALE), "m").otherwise("n"))


def _given(m: Column) -> Column:
    """The given name of a mention with titles, given name and surname, else null."""
    parts = F.split(F.substr(m, F.length(_titles(m)) + 1), " ")
    return F.when((_titles(m) != "") & (F.size(parts) > 1), F.lower(F.get(parts, F.lit(0))))


def _canon(m: Column, kind: Column) -> Column:
    """Canonical form of a mention of a kind; of a name, that of its surname."""
    return F.when(kind == "email", F.lower(m)).when(kind.isin("ssn", "card", "account"), _digits(m)).when(kind == "phone", F.right(_digits(m), F.lit(10))).when(kind == "name", _surname(m)).otherwise(m)


def entities_of(m: Column, secret: Column | None = None) -> Column:
    """Entities of one mention as an array of struct(kind, canon)."""

    def told(kind: Column) -> Column:
        one = F.struct(F.when(kind == "name", "surname").otherwise(kind).alias("kind"), _canon(m, kind).alias("canon"))
        given = F.struct(_given_kind(m).alias("kind"), _given(m).alias("canon"))
        return F.filter(F.array(one, given), lambda e: (kind != "none") & ((e["kind"] == one["kind"]) | (kind == "name") & e["canon"].isNotNull()))

    return _bind(kind_of(m, secret), told)


def _pick(h: Column, at: int, values: list[str]) -> Column:
    """One of 16 values by the hex digit of h at a place."""
    return F.element_at(F.array(*map(F.lit, values)), F.conv(F.substring(h, at, 1), 16, 10).cast("int") + 1)


def _fit(canon: Column, h: Column) -> Column:
    """Same class at each place: digit, lower or upper letter of the same script; the rest stays."""
    deep = F.concat(h, F.sha2(h, 512))

    def place(c: Column, i: Column) -> Column:
        at = F.conv(F.substring(deep, i % 126 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        new = None
        for script, letters in ALPHABETS.items():
            one = F.substring(F.lit(letters), at % len(letters) + 1, F.lit(1))
            if script == "Latin":
                new = new.otherwise(one)
            else:
                is_ = c.rlike(rf"\p{{Is{script}}}")
                new = F.when(is_, one) if new is None else new.when(is_, one)
        return F.when(c.rlike("[0-9]"), (at % 10).cast("string")).when(c.rlike(r"\p{L}"), F.when(c == F.lower(c), new).otherwise(F.upper(new))).otherwise(c)

    return F.array_join(F.transform(F.split(canon, ""), place), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of digits followed by a check digit that is still to come, modulo ten."""
    back = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(back, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10


def _sound(digits: Column) -> Column:
    """Whether the last digit is the Luhn check digit of the others."""
    n = F.length(digits)
    return F.pmod(_luhn(F.left(digits, n - 1)) + F.right(digits, F.lit(1)).cast("int"), F.lit(10)) == 0


def _card(canon: Column, fit: Column, off: int = 0) -> Column:
    body = F.concat(F.left(canon, F.lit(1)), F.substr(fit, F.lit(2), F.length(canon) - 2))
    return F.concat(body, F.pmod(-_luhn(body) + F.lit(off), F.lit(10)).cast("string"))


def surrogate_of(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 512)
    formed = F.when(kind == "email", F.substring_index(canon, "@", 1)).when(~kind.isin("ip", "surname", "given_m", "given_f", "given_n"), canon)
    return _bind(h, lambda h: _bind(_fit(formed, h), lambda fit: _surrogate(kind, canon, attempt, key, h, fit)))


def _surrogate(kind: Column, canon: Column, attempt: Column, key: str, h: Column, fit: Column) -> Column:
    """The surrogate from the hash and from what has the form of canon (of an email, of its local part)."""
    octets = F.concat_ws(".", *[(F.conv(F.substring(h, 1 + 4 * i, 4), 16, 10).cast("long") % (223 if i == 0 else 254) + 1).cast("string") for i in range(4)])
    domain = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.substring_index(canon, "@", -1)), 512)
    host = F.translate(F.substring(domain, 1, 12), "0123456789", "ghijklmnop")
    secret = F.when(canon.rlike("^[0-9a-f]+$"), F.left(F.repeat(F.concat(h, F.sha2(h, 512)), F.ceil(F.length(canon) / 256).cast("int")), F.length(canon))).otherwise(fit)
    more_letters = F.left(F.translate(F.sha2(h, 512), "0123456789", "ghijklmnop"), F.greatest(attempt - (WIDEN - 1), F.lit(0)))
    more_digits, more_hex = F.translate(more_letters, "abcdefghijklmnop", "0123456789012345"), F.translate(more_letters, "ghijklmnop", "0123456789")
    email = F.concat(fit, more_letters, F.lit("@"), host, F.lit(".example"))
    secret = F.concat(secret, F.when(canon.rlike("^[0-9a-f]+$"), more_hex).otherwise(more_letters))
    by_script = lambda of: F.when(canon.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))
    syllables = lambda s: F.array_join(F.transform(F.sequence(F.lit(1), attempt + 3), lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES[s])), F.conv(F.substring(h, i % 128 + 1, F.lit(1)), 16, 10).cast("int") + 1)), "")
    family = F.initcap(by_script(syllables))
    more = F.when(attempt == 0, "").otherwise(F.concat(F.lit("-"), family))
    given = lambda g: F.concat(by_script(lambda s: _pick(h, 1, GIVEN[g, s])), more)
    return (F.when(kind == "email", email).when(kind == "ip", F.concat(octets, F.when(more_digits != "", F.concat(F.lit("."), more_digits)).otherwise(""))).when(kind == "card", F.concat(_card(canon, fit), more_digits)).when(kind == "account", F.concat(_card(canon, fit, 1), more_digits)).when(kind == "access_key", F.concat(F.lit("AKIA"), F.substr(fit, F.lit(5)), F.upper(more_letters)))
            .when(kind == "phone", F.concat((F.conv(F.substring(h, 120, 1), 16, 10).cast("int") % 8 + 2).cast("string"), F.substr(fit, F.lit(2)), more_digits)).when(kind == "ssn", F.concat(fit, more_digits))
            .when(kind == "surname", family).when(kind == "given_m", given("m")).when(kind == "given_f", given("f")).when(kind == "given_n", given("n")).otherwise(secret))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, canon, surrogate), one for each distinct entity; surrogates of a kind are distinct
    and none of them is an entity of the kind."""
    sur = lambda d: d.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("canon"), F.col("attempt"), key))
    e = cut(sur(entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0))))
    real = e.select("kind", F.lower("canon").alias("low"))
    while True:
        by = e.withColumn("low", F.lower("surrogate"))
        first = by.groupBy("kind", "low").agg(F.min("canon").alias("first"), F.count("*").alias("n"))
        clash = first.join(real.withColumn("taken", F.lit(True)), ["kind", "low"], "left").where("n > 1 or taken").select("kind", "low", "first", F.coalesce("taken", F.lit(False)).alias("taken"))
        clash = cut(clash)
        if not clash.head(1):
            return e.select("kind", "canon", "surrogate")
        moved = by.join(clash, ["kind", "low"], "left").withColumn("attempt", F.col("attempt") + F.when(F.col("taken") | (F.col("first") != F.col("canon")), 1).otherwise(0))
        e = cut(sur(moved.select("kind", "canon", "attempt")))


def _place_digits(m: Column, digits: Column) -> Column:
    """The last digits of m, as many as given, replaced in order; all else stays."""
    start = F.struct((F.length(digits) - F.length(_digits(m))).alias("k"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        new = F.when(is_digit & (a["k"] >= 0), F.substr(digits, a["k"] + 1, F.lit(1))).otherwise(c)
        return F.struct((a["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"), F.concat(a["out"], new).alias("out"))

    return F.aggregate(F.split(m, ""), start, step)["out"]


def _as(m: Column, s: Column) -> Column:
    """In capitals if the mention is."""
    return F.when(m == F.upper(m), F.upper(s)).otherwise(s)


def render(m: Column, known: Column, secret: Column | None = None) -> Column:
    """The mention with the surrogates of its entities, in its own format."""
    at = lambda k, c: F.element_at(known, F.concat_ws("\x1f", k, c))

    def told(kind: Column, canon: Column, own: Column) -> Column:
        placed = F.concat(_place_digits(m, F.left(own, F.length(canon))), F.substr(own, F.length(canon) + 1))  # what a late attempt adds comes last
        rest = F.substr(m, F.length(_titles(m)) + 1)
        given = _bind(_given(m), lambda g: F.when(g.isNotNull(), _as(F.substring_index(rest, " ", 1), at(_given_kind(m), g))))
        name = F.concat(_titles(m), F.concat_ws(" ", given, _as(F.substring_index(m, " ", -1), at(F.lit("surname"), canon))))
        return F.when(kind == "none", m).when(kind == "name", name).when(kind.isin("phone", "card", "account", "ssn"), placed).when(kind == "email", _as(m, own)).otherwise(own)

    return _bind(kind_of(m, secret), lambda kind: _bind(_canon(m, kind), lambda canon: _bind(at(kind, canon), lambda own: told(kind, canon, own))))


def bare(token: Column) -> Column:
    """A word without quotes and hyphens around it and the ending of the possessive."""
    return F.regexp_replace(F.regexp_replace(token, "^['-]+|['-]+$", ""), "'s$", "")


def repeats(gap: Column, known: Column) -> Column:
    """A stretch between mentions with the names of known (kind and canonical form to surrogate) replaced wherever
    they stand as words of their own, as struct(text, n). A word that is a surname and a given name is the surname."""

    def one(token: Column) -> Column:
        word = bare(token)
        at = lambda k: F.element_at(known, F.concat_ws("\x1f", F.lit(k), F.lower(word)))
        new = F.when(word.rlike(r"^\p{Lu}"), F.coalesce(*map(at, ("surname", "given_m", "given_f", "given_n"))))
        start = F.position(word, token)
        whole = F.concat(F.left(token, start - 1), F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(new)).otherwise(new), F.substr(token, start + F.length(word)))
        return F.struct(F.coalesce(whole, token).alias("t"), F.when(new.isNotNull(), 1).otherwise(0).alias("n"))

    words = F.transform(F.split(gap, WORD_ENDS), one)
    return F.struct(F.array_join(F.transform(words, lambda w: w["t"]), "").alias("text"), F.aggregate(words, F.lit(0), lambda a, w: a + w["n"]).alias("n"))


def mentions_of(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def secret_key(spark) -> str:
    """The key of the session (spark.vistrack.pii.key). Without one the known test key, with a warning: it hides nothing
    from those who know it, so set a key of your own wherever surrogates are to protect anybody."""
    key = spark.conf.get("spark.vistrack.pii.key", None) or spark.sparkContext.getConf().get("spark.vistrack.pii.key", None)
    if not key:
        warnings.warn("spark.vistrack.pii.key is not set: surrogates are made with the public test key", stacklevel=2)
    return key or TEST_KEY


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with every mention replaced; count_col, if named, is added with the mentions of a row, repeated names
    among them. The same
    key gives the same surrogates; keep it secret."""
    if not key:
        raise ValueError("replace_pii needs a key")
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    text = F.col("row")[text_col].cast("string")
    marked = packed.withColumn("mentions", mentions_of(text))
    some = marked.where(F.size("mentions") > 0).withColumn("secrets", F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1)), lambda x: x != ""))
    some = stored(some.withColumn("uid", F.monotonically_increasing_id()), "pii")
    entity = some.select("uid", F.explode(F.array_distinct(F.flatten(F.zip_with("mentions", "secrets", entities_of)))).alias("e")).select("uid", "e.*")
    entity = stored(entity, "pii-entities")
    names = surrogates(entity, key)
    known = entity.join(names, ["kind", "canon"]).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "canon"), "surrogate"))).alias("known"))
    # collect_list is bounded by the mentions of one text
    gaps, new = F.split(text, PATTERN, -1), F.zip_with("mentions", "secrets", lambda m, s: render(m, F.col("known"), s))
    named = F.exists(F.map_keys("known"), lambda k: k.startswith("surname"))
    told = F.transform(gaps, lambda g: F.when(named, repeats(g, F.col("known"))).otherwise(F.struct(g.alias("text"), F.lit(0).alias("n"))))
    # the explode of one value keeps the plan from looking for names at each of their uses
    done = some.join(known, "uid", "left").withColumn("_told", F.explode(F.array(told)))
    pieces = F.transform(F.arrays_zip(F.col("_told").alias("g"), new.alias("n")), lambda z: F.concat(z["g"]["text"], F.coalesce(z["n"], F.lit(""))))
    done = done.withColumn("_text", F.array_join(pieces, ""))
    numbered = dict(docs.dtypes).get("n_chars") == "bigint" and text_col == "text"
    put = lambda c: F.col("_text").alias(c) if c == text_col else F.length("_text").cast("long").alias(c) if c == "n_chars" and numbered else F.col("row")[c].alias(c)
    count = lambda x: [x.cast("long").alias(count_col)] if count_col else []
    found = F.size(F.filter(F.zip_with("mentions", "secrets", kind_of), lambda k: k != "none")) + F.aggregate("_told", F.lit(0), lambda a, g: a + g["n"])
    changed = done.select(*[put(c) for c in own], *count(found))
    same = marked.where(F.coalesce(F.size("mentions"), F.lit(0)) <= 0).select(*[F.col("row")[c].alias(c) for c in own], *count(F.lit(0)))
    return same.unionByName(changed) if len(set(own)) == len(own) else same.union(changed)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(docs, secret_key(spark), count_col="n_mentions")

