"""Keyed surrogates for personal data and secrets, in DataFrame and SQL functions only.

One pattern finds e-mail and IP addresses, phone, card (by their Luhn check),
social-security and bank account numbers, access keys, assigned secrets and names
after a title; in a document with such names, their words are found without a title too.
Each entity becomes atoms (a name has one per word, an e-mail address its local part
and its domain, all else one), and each distinct atom of the corpus gets one surrogate:
a keyed hash drives replacements of the same type and format (digits by digits, card
numbers with a Luhn check, hex keys by hex, given names of the gender that most titles
of the corpus tell, names in the same script and case). A check over all atoms redraws
those whose surrogate another atom has or that is itself an atom of the corpus, so
different entities stay different; names and e-mail parts grow with every draw, so
there are values for any number of them. Equal entities, also differently written
numbers, a name under another title or none and two addresses of one domain, stay equal.

The key is an argument; :func:`query` takes it from ``spark.tallybook.surrogates.key``
and, where that is unset, draws one for the run, so that nobody can replay it.

Null and empty texts stay as they are. Repeated rows (equal id and text) get the same
result. Of equal draws the least atom keeps it. Extra columns, whatever their names, are
kept, but one named ``n_entities`` is replaced. Texts of any length are searched whole,
one at a time. An empty table gives an empty result.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._common import durable, packed, split_join, unpacked

KEY_SETTING = "spark.tallybook.surrogates.key"
ROUNDS = 64
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин")
FEMALE = ("Mrs", "Ms", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Госпожа")
TITLES = (*MALE, *FEMALE, "Dr", "Prof")
_NAME = r"\p{Lu}\p{L}*(?:['’-]\p{Lu}\p{L}*)*"
#: type -> pattern; the first that fits a place wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:]|\.[0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])",
    "secret": r"(?<=[=: \"'])(?<=\b(?i:token|password|passwd|pwd|secret|api_key|apikey) {0,2}[=:] {0,2}[\"']?)(?=[+/_=.-]*[A-Za-z0-9])[A-Za-z0-9+/_=.-]{8,}",
    "name": rf"(?<!\p{{L}})(?:{'|'.join(TITLES)})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
PATTERN = "|".join(PATTERNS.values())
#: Given names by gender and script.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marc Noel Oscar Paul Robin Simon Tomas Victor".split(),
    ("f", "latin"): "Anna Berta Clara Diana Elena Frida Greta Hanna Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Tania Vera".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Олег".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Софья".split(),
}
SYLLABLES = {"latin": "ba den el fer gor han ist kel lan mor nes ol per quin ros sel tam ur ven wil".split(), "cyrillic": "ба вен гор дел жан зор ир кел лан мор нес ол пер рос сел тар ур фен хан чер".split()}


def kind_of(e: Column, own: Column) -> Column:
    """The type of an entity that the pattern has found; ``mention``: only words of the document's own names; ``number``: no entity."""
    out = F.lit("secret")
    for kind, p in reversed(PATTERNS.items()):
        if kind == "card":
            out = F.when(e.rlike(f"^(?:{p})$"), F.when(luhn(_digits(e)) == 0, F.lit("card")).otherwise(F.lit("number"))).otherwise(out)
        elif kind != "secret":
            out = F.when(e.rlike(f"^(?:{p})$"), F.lit(kind)).otherwise(out)
    return F.when((F.size(own) > 0) & F.forall(F.split(e, " "), lambda w: F.array_contains(own, w)), F.lit("mention")).otherwise(out)


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _name_words(e: Column) -> Column:
    """The words of a name behind its title."""
    return F.split(F.regexp_replace(e, r"^\p{L}+\.? ", ""), " ")


def atoms(kind: Column, e: Column, surnames: Column) -> Column:
    """The atoms of an entity: type, normal form and, for given names, what the title says of the gender (1 male, -1 female, 0)."""
    title = F.regexp_extract(e, r"^(\p{L}+)", 1)
    gender = F.when(title.isin(*MALE), 1).when(title.isin(*FEMALE), -1).otherwise(0)
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    atom = lambda t, norm, g=0: F.struct(t.alias("t"), norm.alias("norm"), (F.lit(g) if isinstance(g, int) else g).alias("g"))
    word = lambda last, w, g: atom(F.concat(F.when(last, "surname:").otherwise("given:"), script(w)), F.lower(w), F.when(last, 0).otherwise(g))
    full = _name_words(e)
    names = F.transform(full, lambda w, i: word(i == F.size(full) - 1, w, gender))
    mention = F.transform(F.split(e, " "), lambda w: word(F.array_contains(surnames, w), w, F.lit(0)))
    mail = F.array(*(atom(F.lit(t), F.lower(F.substring_index(e, "@", at))) for t, at in (("local", 1), ("domain", -1))))
    norm = F.when(kind.isin("phone", "card", "ssn"), _digits(e)).when(kind == "iban", F.regexp_replace(e, " ", "")).when(kind == "ip6", F.lower(e)).otherwise(e)
    return F.when(kind == "name", names).when(kind == "mention", mention).when(kind == "email", mail).otherwise(F.array(atom(kind, norm)))


def _byte(stream: Column, i) -> Column:
    """The i-th (from 0, wrapping) pair of hex digits of a stream as a number."""
    return F.conv(F.substring(stream, F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(127)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(pool: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), F.pmod(n, F.lit(len(pool))) + 1)


def _letters(stream: Column, first: int, n: int) -> Column:
    return F.concat(F.lit(""), *(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(_byte(stream, first + i), F.lit(26)) + 1, F.lit(1)) for i in range(n)))


def _same_shape(e: Column, stream: Column, skip=0, hexes: Column | None = None) -> Column:
    """Every letter and digit from position ``skip`` on replaced by one of its class; where ``hexes`` holds, by a hex digit."""

    hexes = F.lit(False) if hexes is None else hexes

    def swap(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        h = F.substring(F.lit("0123456789abcdef"), F.pmod(b, F.lit(16)) + 1, F.lit(1))
        low = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(b, F.lit(26)) + 1, F.lit(1))
        return (
            F.when((i < skip) | ~c.rlike("[0-9A-Za-z]"), c).when(hexes, F.when(e.rlike("[A-F]"), F.upper(h)).otherwise(h)).when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
            .when(c.rlike("[a-z]"), low).otherwise(F.upper(low))
        )

    return F.array_join(F.transform(F.split(e, ""), swap), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10; 0 means valid."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, b: a + b), F.lit(10))


def draw(t: Column, norm: Column, gender: Column, attempt: int, key: str) -> Column:
    """The surrogate of an atom in a given attempt; those of names and e-mail parts get longer."""
    seed = F.concat_ws("\x1f", F.lit(key), t, norm, F.lit(str(attempt)))
    stream = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1f+")), 512))
    local = F.concat(_same_shape(norm, stream), _letters(stream, 60, max(0, attempt - 1)))
    domain = F.concat(_letters(stream, 100 - attempt, 6 + attempt), F.lit(".example."), _pick(["com", "net", "org"], _byte(stream, 120)))
    ip = F.concat_ws(".", *((F.pmod(_byte(stream, i), F.lit(223 if i == 0 else 254)) + 1).cast("string") for i in range(4)))
    low = 2 if attempt < 6 else 0
    phone = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(i == 0, c).otherwise((F.pmod(_byte(stream, i), F.lit(10 - low)) + low).cast("string"))), "")
    body = F.concat(F.substring(norm, 1, 1), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm) - 2, F.lit(1))), lambda i: F.pmod(_byte(stream, i), F.lit(10)).cast("string")), ""))
    card = F.concat(body, F.pmod(-luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    long_hex = norm.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & norm.rlike("[0-9]") & norm.rlike("[A-Fa-f]")
    keyed = _same_shape(norm, stream, F.length(F.regexp_extract(norm, "^(AKIA|gh[pousr]_|sk-)", 1)))
    g = F.when(gender > 0, "m").when(gender < 0, "f").when(F.pmod(_byte(stream, 9), F.lit(2)) == 0, "m").otherwise("f")
    script = F.substring_index(t, ":", -1)
    given = surname = F.lit(None).cast("string")
    for (sex, kind), pool in GIVEN.items():
        tail = [F.initcap(_pick(SYLLABLES[kind], _byte(stream, 10))), *(_pick(SYLLABLES[kind], _byte(stream, 11 + i)) for i in range(attempt - 2))]
        given = F.when((g == sex) & (script == kind), F.concat(_pick(pool, _byte(stream, 2)), *([F.lit("-"), *tail] if attempt > 1 else []))).otherwise(given)
    for kind, pool in SYLLABLES.items():
        surname = F.when(script == kind, F.initcap(F.concat(*(_pick(pool, _byte(stream, i)) for i in range(3 + attempt))))).otherwise(surname)
    return (
        F.when(t == "local", local).when(t == "domain", domain).when(t == "ip", ip).when(t == "ip6", _same_shape(norm, stream, 0, F.lit(True))).when(t.isin("phone", "ssn"), phone).when(t == "card", card)
        .when(t == "iban", F.concat(F.substring(norm, 1, 2), _same_shape(F.substring(norm, 3, 100), stream))).when(t == "key", keyed)
        .when(t.startswith("given"), given).when(t.startswith("surname"), surname).otherwise(_same_shape(norm, stream, 0, long_hex))
    )


def assign(distinct_atoms: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """``distinct_atoms(t, norm, gender, ...)`` with ``s``: a surrogate different for different atoms of a type, none of them an atom itself.

    Each round draws for the atoms still without one and writes only what it has found.
    """
    every = durable(distinct_atoms)
    taken = every.select("t", F.lower("norm").alias("sl"))
    open_, done = every, []
    for attempt in range(rounds):
        drawn = durable(open_.withColumn("s", draw(F.col("t"), F.col("norm"), F.col("gender"), attempt, key)).withColumn("sl", F.lower("s")))
        first = drawn.groupBy("t", "sl").agg(F.min("norm").alias("norm"))
        good = drawn.join(first, ["t", "sl", "norm"]).join(taken, ["t", "sl"], "left_anti")
        for d in done:
            good = good.join(d.select("t", F.lower("s").alias("sl")), ["t", "sl"], "left_anti")
        done.append(durable(good.select(*every.columns, "s")))
        open_ = durable(open_.join(done[-1].select("t", "norm"), ["t", "norm"], "left_anti"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"surrogates still collide after {rounds} rounds; a fixed format leaves too few values")


def fill(e: Column, digits: Column) -> Column:
    """``e`` with its digits replaced in turn by ``digits``."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["x"], F.substring(digits, s["k"] + 1, F.lit(1))).alias("x"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["x"], c).alias("x"), s["k"].alias("k")))
    return F.aggregate(F.split(e, ""), F.struct(F.lit("").alias("x"), F.lit(0).alias("k")), step, lambda s: s["x"])


def _found(rows: DataFrame) -> DataFrame:
    """Every match of every document with one: ``_k, pos, e, own`` (words of the document's names), ``surnames`` and the ``pattern`` that finds them."""
    text = rows.select("_k", F.col("_row.text").alias("x"))
    once = text.select("_k", "x", F.regexp_extract_all("x", F.lit(PATTERN), F.lit(0)).alias("e1"))
    named = once.select("_k", "x", "e1", F.transform(F.filter("e1", lambda e: e.rlike(f"^(?:{PATTERNS['name']})$")), _name_words).alias("names"))
    cases = lambda w: F.array_union(w, F.transform(w, F.upper))
    words = named.select("_k", "x", "e1", cases(F.flatten("names")).alias("own"), cases(F.transform("names", lambda w: F.element_at(w, -1))).alias("surnames"))
    longest = F.array_join(F.array_sort("own", lambda a, b: F.length(b) - F.length(a)), "|")
    mention = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), longest, F.lit(")(?: (?:"), longest, F.lit(r"))*(?![\p{L}\p{N}])"))
    both = words.select("_k", "x", "e1", "own", "surnames", F.when(F.size("own") > 0, mention).alias("pattern"))
    ents = F.when(F.col("pattern").isNull(), F.col("e1")).otherwise(F.regexp_extract_all("x", "pattern", F.lit(0)))
    return both.select("_k", "own", "surnames", "pattern", F.posexplode(ents).alias("pos", "e")).dropDuplicates(["_k", "pos"])


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``; adds ``n_entities``. The same ``key`` gives the same surrogates."""
    rows = packed(docs, "doc_id", "text")
    each = durable(_found(rows).withColumn("kind", kind_of(F.col("e"), F.col("own"))))
    parts = each.where("kind <> 'number'").select("_k", "pos", F.posexplode(atoms(F.col("kind"), F.col("e"), F.col("surnames"))).alias("part", "a")).select("_k", "pos", "part", "a.*")
    parts = durable(parts)
    table = assign(parts.groupBy("t", "norm").agg(F.sum("g").alias("gender"), F.count("*").alias("n")), key)
    made = split_join(parts, table.select("t", "norm", "s", "n"), ["t", "norm"], "n")
    made = made.groupBy("_k", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "s"))), lambda x: x["s"]).alias("s"))
    e, s, kind = F.col("e"), F.array_join("s", " "), F.col("kind")
    case = lambda whole, new: F.when((whole == F.upper(whole)) & (F.length(whole) > 1), F.upper(new)).otherwise(new)
    title = F.regexp_extract(e, r"^(\p{L}+\.? )", 1)
    out = (
        F.when(kind == "number", e).when(kind == "name", F.concat(title, case(F.substring(e, F.length(title) + 1, F.length(e)), s))).when(kind == "mention", case(e, s))
        .when(kind == "email", F.array_join("s", "@")).when(kind.isin("phone", "card", "ssn"), fill(e, s))
        .when((kind == "iban") & e.contains(" "), F.rtrim(F.regexp_replace(s, "(.{4})", "$1 ")))
        .otherwise(s)
    )
    news = each.join(made, ["_k", "pos"], "left").select("_k", "pos", "pattern", (kind != "number").cast("int").alias("real"), out.alias("new"))
    news = news.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("news"), F.sum("real").cast("int").alias("n"), F.first("pattern").alias("pattern"))
    old = F.col("_row.text")
    gaps = F.split(old, F.coalesce("pattern", F.lit(PATTERN)), F.lit(-1))
    text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("news", i), F.lit("")))), "")
    n = F.coalesce("n", F.lit(0))
    return unpacked(rows.join(news, "_k", "left"), docs.columns, {"text": F.when(n > 0, text).otherwise(old)}, n_entities=n)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)
    return replace_entities(docs, key).select("doc_id", "n_entities", "text")


QUERIES: dict[str, Callable] = {"op6_surrogates": query}
