"""Secret scans: pattern candidates, and a random forest that removes the false ones.

Candidates are runs of key-like characters, values that are assigned to names such as ``password`` or said of them in a
sentence, passwords of addresses (``scheme://user:password@host``) and private-key blocks. Each is
described by its length, the transitions between its kinds of characters, the share of it that dictionary words cover,
the path around it and its neighbouring words. The forest is trained on labelled findings and turned into a Column
expression, so a scan or a redaction is one narrow pass of DataFrame functions: no Python, no shuffle.

A text is cut once at its candidates, into pieces that alternate between what lies between and the candidates. Each
candidate is judged where it stands, by the pieces around it, and a redaction joins the pieces again, so the work follows
the length of the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trees and their depth; labelled findings that are built for training; words of the dictionary.
TREES, TREE_DEPTH, EXAMPLES, DICTIONARY = 20, 7, 11_200, 1_000
#: Characters before and after a candidate that count as its neighbourhood.
BEFORE, AFTER = 64, 24
REDACTED = "[SECRET]"

# Patterns of candidates, names and formats.
KEY_RUN = r"[A-Za-z0-9+_~][A-Za-z0-9+/_~.\-]{10,}[A-Za-z0-9+_~]={0,2}"
NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|auth|bearer|credentials?)"
ASSIGNING = rf"(?i:{NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?"
SAYING = rf"\b(?i:{NAMES})\s(?i:is|was)\s{{1,3}}[\"']?"
USER, PASSWORD = r"://[^\s/:@\"'<>\x01\x02]{0,64}:", r"[^\s/@\"'<>\x01\x02]{3,}(?=@)"
VALUE = r"[^\s\"',;<>\x01\x02]{5,}[^\s\"',;<>.)\]}\x01\x02]"
BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*-----END [A-Z ]{0,40}PRIVATE KEY-----"
FORMATS = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{12,}|gh[pousr]_|xox[abpr]-|sk-|AIza|eyJ|glpat-|-----BEGIN )"
DOUBT = r"(?i)\b(?:commit|sha-?\d*|md5|checksum|digest|hash|uuid|guid|id|version|isbn|revision|rev|etag|build|ref|base64|integrity|sha\d+-)\b[\W_]{0,3}\Z"
SHAM = r"(?i)(?:example|sample|dummy|placeholder|changeme|your[_\-]|test|fake|x{4,}|1234|<|\*{3})"

CALL = r"[(\[]|^\$|^%|^\{|^[a-z_]+(?:\.[a-z_]+)+$"

FEATURES = ("length", "transitions", "distinct", "digits", "upper", "hex", "covered", "slashes", "dots", "dashes", "address", "named", "doubted", "format", "sham", "user", "call")


#: Marks around candidates, and how texts that hold such characters themselves are written meanwhile.
MARK, ESCAPES = "\u0001", (("\u0002", "\u0002\u0004"), ("\u0001", "\u0002\u0003"))
#: Pieces before or after a candidate that hold its neighbourhood in any case; lengths that are summed at once.
AROUND, TOGETHER = 32, 256


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def pieces(text: Column) -> Column:
    """The text as array<string>, in whose places from 0, by four: text between, a value after a name or a private-key block,
    nothing, a run of key-like characters; one of the latter two is empty.

    Values and blocks are marked first, then runs in the rest. A null text has one empty piece.
    """
    text = F.coalesce(text, F.lit(""))
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    named = F.regexp_replace(text, F.lit(f"({BLOCK})|({ASSIGNING}|{SAYING})({VALUE})|({USER})({PASSWORD})"), F.lit(f"$2$4{MARK}$1$3$5{MARK}"))
    marked = F.regexp_replace(named, F.lit(f"{MARK}([^{MARK}]*){MARK}|({KEY_RUN})"), F.lit(f"{MARK}$1{MARK}{MARK}$2{MARK}"))

    def unescaped(x: Column) -> Column:
        for plain, escaped in reversed(ESCAPES):
            x = F.replace(x, F.lit(escaped), F.lit(plain))
        return x

    return F.transform(F.split(marked, MARK, -1), unescaped)


def _is_candidate(x: Column, i: Column) -> Column:
    """Whether piece ``x`` at place ``i`` is a candidate: runs need a letter and a digit."""
    return ((i % 4 == 1) & (x != "")) | ((i % 4 == 3) & x.rlike("[0-9]") & x.rlike("[A-Za-z]"))


def _described(p: Column, x: Column, i: Column) -> Column:
    """Piece ``x`` at place ``i`` of ``p`` as struct<value, before, after>."""
    near = F.slice(p, F.greatest(i - AROUND, F.lit(0)) + 1, F.least(i, F.lit(AROUND)))
    before = F.right(F.array_join(F.transform(near, lambda y: F.right(y, F.lit(BEFORE))), ""), F.lit(BEFORE))
    after = F.left(F.array_join(F.transform(F.slice(p, i + 2, AROUND), lambda y: F.left(y, F.lit(AFTER))), ""), F.lit(AFTER))
    return F.struct(x.alias("value"), before.alias("before"), after.alias("after"))


def _start(lengths: Column, sums: Column, i: Column) -> Column:
    """The sum of the first ``i`` lengths, from sums of TOGETHER of them each."""
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    block = F.floor(i / TOGETHER).cast("int")
    return add(F.slice(sums, F.lit(1), block)) + add(F.slice(lengths, block * TOGETHER + 1, i % TOGETHER))


def candidates(text: Column) -> Column:
    """The candidates of a text in order, as array<struct<value, start (from 0), before, after>>. A null text has none."""

    def listed(p: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: _is_candidate(F.get(p, i), i))
        known = F.transform(places, lambda i: F.struct(i.alias("i"), _described(p, F.get(p, i), i).alias("x")))
        lengths = F.transform(p, lambda x: F.length(x).cast("long"))

        def summed(ls: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(ls) / TOGETHER).cast("int")), lambda b: F.aggregate(F.slice(ls, b * TOGETHER + 1, TOGETHER), F.lit(0).cast("long"), lambda a, x: a + x))
            return let(sums, lambda ss: F.transform(known, lambda c: F.struct(c["x"]["value"].alias("value"), _start(ls, ss, c["i"]).alias("start"), c["x"]["before"].alias("before"), c["x"]["after"].alias("after"))))

        return let(lengths, summed)

    return let(pieces(text), listed)


def features(x: Column, dictionary: list[str]) -> Column:
    """The features of one candidate (a struct of value, before, after), as array<double> in the order of FEATURES."""
    v, before = x["value"], x["before"]
    n = F.length(v).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9"), "[^aA9]", ".")
    changes = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    count = lambda pattern: F.length(F.regexp_replace(v, f"[^{pattern}]", "")).cast("double")
    words = F.array(*[F.lit(w) for w in dictionary]) if dictionary else F.array().cast("array<string>")
    known = F.filter(F.regexp_extract_all(F.lower(v), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: F.array_contains(words, w))
    around = F.concat(F.regexp_extract(before, r"(\S*)\Z", 1), F.regexp_extract(x["after"], r"\A(\S*)", 1))
    flag = lambda c: c.cast("double")
    return F.array(
        n,
        changes / F.greatest(n - 1, F.lit(1.0)),
        F.size(F.array_distinct(F.split(v, ""))) / n,
        count("0-9") / n,
        count("A-Z") / n,
        flag(v.rlike(r"^[0-9a-fA-F]+$")),
        F.aggregate(known, F.lit(0.0), lambda a, w: a + F.length(w)) / n,
        count("/") + F.length(F.regexp_replace(around, r"[^/\\]", "")),
        count("."),
        count(r"\-"),
        flag(around.rlike("@|://")),
        flag(before.rlike(rf"(?i){NAMES}[\"']?\s{{0,3}}(?:[:=]|is|was)?\s{{0,3}}[\"']?\Z")),
        flag(before.rlike(DOUBT)),
        flag(v.rlike(FORMATS)),
        flag(v.rlike(SHAM)),
        flag(before.rlike(rf"{USER}\Z") & x["after"].startswith("@")),
        flag(v.rlike(CALL)),
    )


def example_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(text, label): labelled findings of 28 kinds, 12 real and 16 false, built from hashes of their numbers.

    For use where no reviewed findings are at hand; :func:`trained` takes any table of this form.
    """
    d = spark.range(0, n, 1, 1).withColumn("h", F.sha2(F.col("id").cast("string"), 256)).withColumn("g", F.sha2(F.concat(F.lit("g"), F.col("id").cast("string")), 256))
    h, g, i = F.col("h"), F.col("g"), F.col("id")
    mixed = F.translate(F.base64(F.unhex(F.concat(h, g))), "+/=\r\n", "xY")
    word = F.translate(F.left(g, F.lit(9)), "0123456789", "aeiolnrstu")
    size = F.lit(16) + F.pmod(i, F.lit(17))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = F.pmod(i * 7, F.lit(1000)).cast("string")
    sham = F.element_at(F.array(F.lit("your_password_123"), F.lit("example-key-0001"), F.lit("xxxxxxxxxxxx1"), F.lit("changeme1234"), F.lit("test_token_000")), (F.pmod(F.floor(i / 16), F.lit(5)) + 1).cast("int"))
    name = F.element_at(F.array(F.lit("password="), F.lit('token = "'), F.lit("api_key: "), F.lit('secret = "'), F.lit("passwd: ")), (F.pmod(F.floor(i / 16), F.lit(5)) + 1).cast("int"))
    kinds = [
        (join(word, " password=", F.left(h, size), " and ", word), 1), (join(word, ' token = "', F.left(h, F.lit(40)), '" ', word), 1), (join(word, " AKIA", F.upper(F.left(mixed, F.lit(16))), " ", word), 1), (join("ghp_", F.left(mixed, F.lit(36)), " ", word), 1),
        (join(name, F.left(mixed, size + 8), " ", word), 1), (join('"secret": "', F.left(h, F.lit(32)), '", ', word), 1), (join("Authorization: Bearer eyJ", F.left(mixed, F.lit(30)), ".", F.right(mixed, F.lit(40))), 1), (join(word, " sk-", F.left(mixed, F.lit(48)), " ", word), 1),
        (join(word, number, "@mail", number, ".example.com ", word), 0), (join("https://", word, ".example.org/", F.left(h, F.lit(8)), "/page", number, ".html"), 0), (join("commit ", F.left(h, F.lit(40)), " ", word), 0), (join("/usr/lib/", word, "-", number, "/", word, number, ".so"), 0),
        (join("id ", F.left(h, F.lit(8)), "-", F.substring(h, 9, 4), "-", F.substring(h, 13, 4), "-", F.substring(h, 17, 4), "-", F.substring(h, 21, 12), " ", word), 0), (join(word, " ", word, F.left(word, F.lit(4)), number, "-final ", word), 0), (join("sha256 ", h, " ", word), 0), (join(name, sham, " ", word), 0),
        (join("db: postgres://", word, ":", F.left(mixed, F.lit(8) + F.pmod(i, F.lit(9))), "@", word, ".example.net/prod"), 1), (join("amqp://app:", word, number, "!@", word, ":5672/"), 1), (join("my password is ", F.left(word, F.lit(4) + F.pmod(i, F.lit(6)).cast("int")), F.left(h, F.pmod(i, F.lit(3)).cast("int")), F.left(number, F.lit(2)), F.left(F.reverse(word), F.pmod(i, F.lit(7)).cast("int")), F.right(number, F.lit(1)), " ", word), 1), (join("The api key was ", F.left(mixed, size + 6), " ", word), 1),
        (join("the password is ", word, " to ", word), 0), (join("the token is ", F.left(word, F.lit(7)), "ed ", word), 0), (join("data:image/png;base64,", mixed, F.reverse(mixed), "=="), 0), (join('integrity="sha384-', F.left(mixed, F.lit(64)), '" ', word), 0),
        (join(name, "${", F.upper(word), "} ", word), 0), (join(name, "get_", word, "(", word, ") ", word), 0), (join(name, word, ".", word, ".value ", word), 0), (join("static/", word, ".", F.left(h, F.lit(8)), ".min.js ", word), 0),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    pick = lambda at: reduce(lambda rest, k: F.when(kind == k[0], k[1][at] if at == 0 else F.lit(k[1][1])).otherwise(rest), enumerate(kinds), F.lit(None))
    return d.select(pick(0).alias("text"), pick(1).cast("int").alias("label"))


def dictionary_of(docs: DataFrame, text: str = "text", words: int = DICTIONARY) -> list[str]:
    """Words of three letters or more that most documents have, counted over all documents."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]{3,}\b"), F.lit(0)))).alias("w"))
    return sorted(r["w"] for r in found.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).collect())


def trained(findings: DataFrame, dictionary: list[str], seed: int = 11) -> RandomForestClassificationModel:
    """A random forest from labelled findings (text, label 0/1): the first candidate of each text is the finding."""
    rows = findings.select(F.get(candidates(F.col("text")), F.lit(0)).alias("x"), "label").where("x is not null")
    rows = rows.select(array_to_vector(features(F.col("x"), dictionary)).alias("features"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def forest(model: RandomForestClassificationModel, f: Column) -> Column:
    """The model's probability of label 1 as an expression on a feature array."""

    def grown(node) -> Column:  # noqa: ANN001
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return F.lit(float(stats[1] / sum(stats)))
        split = node.split()
        return F.when(F.get(f, F.lit(split.featureIndex())) <= split.threshold(), grown(node.leftChild())).otherwise(grown(node.rightChild()))

    trees = [grown(t._call_java("rootNode")) for t in model.trees]
    return reduce(lambda a, b: a + b, trees) / len(trees)


def score(x: Column, model: RandomForestClassificationModel, dictionary: list[str]) -> Column:
    """The forest's score of one candidate."""
    return let(features(x, dictionary), lambda f: forest(model, f))


def found(docs: DataFrame, model: RandomForestClassificationModel, dictionary: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, value, score, is_secret): one row per place of a candidate in a document.

    start is the place in characters, from 0; a value that stands at several places is judged at each. Null and empty texts
    give no row; other columns are not used.
    """
    d = docs.select(F.col(key).alias("k"), F.explode(candidates(F.col(text))).alias("s")).select("k", "s", score(F.col("s"), model, dictionary).alias("score"))
    return d.select(F.col("k").alias(key), F.col("s.start").alias("start"), F.length("s.value").alias("length"), F.col("s.value").alias("value"), "score", (F.col("score") >= 0.5).alias("is_secret"))


def redacted(docs: DataFrame, model: RandomForestClassificationModel, dictionary: list[str], text: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by REDACTED, each where it was found; all rows and columns stay."""

    def clean(p: Column) -> Column:
        secret = lambda x, i: let(_described(p, x, i), lambda c: score(c, model, dictionary) >= 0.5)
        kept = lambda x, i: F.when(_is_candidate(x, i), F.when(secret(x, i), F.lit(REDACTED)).otherwise(x)).otherwise(x)
        return F.array_join(F.transform(p, kept), "")

    return docs.withColumn(text, F.when(F.col(text).isNotNull(), let(pieces(F.col(text)), clean)))


def secrets_of_documents(docs: DataFrame) -> DataFrame:
    """All candidates of all documents with their scores, by a forest trained on :func:`example_findings`."""
    dictionary = dictionary_of(docs)
    return found(docs, trained(example_findings(docs.sparkSession), dictionary), dictionary)
