"""Secret scan with a random forest against false positives, in DataFrame functions only.

A candidate is a maximal run of at least ``LEAST_CHARS`` characters of ``[A-Za-z0-9_+/=.~-]``. A
regular expression marks all candidates of a text, which cuts it into pieces; every candidate is
described by its length, its character mix and transitions, how much of it is dictionary words, the
path of its document and the words before and after it. A random forest, fitted on labelled findings
with the same column expressions and written as one column expression, gives the share of trees that
call it a secret. A text is handled in one row from scan to redaction; nothing is shuffled.

The labelled findings are a table made by rule (``labelled_findings``, ``FINDINGS`` rows of a fixed
seed): keys, tokens and passwords of common shapes, against checksums, identifiers, paths, numbers,
placeholders and long words. Only this table, of fixed size, meets the driver.

Results for odd input: a null or empty text has no candidate and stays as it is; a null path counts
as an unknown path; the control characters U+0001 and U+0002, which serve as marks, count as spaces,
and become spaces in texts that are redacted; equal secrets in a text are found each; repeated rows
and null ids are kept; texts of any length are read whole; other columns are only carried when named
in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightline.llm.forest import Node, fold, grow_forest
from flightline.llm.text import let

LEAST_CHARS = 16
CONTEXT_CHARS = 48
FINDINGS = 1_200
TREES, DEPTH, SEED = 15, 6, 7
THRESHOLD = 0.5
REDACTED = "[SECRET]"

_OPEN, _CLOSE = "\x01", "\x02"
_CANDIDATE = r"([A-Za-z0-9_+/=.~-]{%d,}+)" % LEAST_CHARS

# Fixed word list: pieces of ordinary text and identifiers that random keys seldom hold.
DICTIONARY = (
    "access action admin application array async background based build button cache change client code "
    "color common component config connect content control count create data date default description "
    "document element email enable error event example field file filter form format function get group "
    "handle html http image import index info input install int internal into item java key label "
    "language layout line list local login main make manager media message method model module name "
    "network node number object page param password path plugin point product project property public "
    "query read record report request resource response result root sample schema script search select "
    "server service session set size some source start state status step string style system table target "
    "task template test text that the their them there this time title token tool tree type update url "
    "use user util value version web where which width window work world write ation tion ment ness ing "
    "ble ver "
).split()

FEATURES = (
    "length", "digits", "upper", "lower", "marks", "hexadecimal", "transitions", "letter_runs", "vowels",
    "distinct", "covered", "prefix", "placeholder", "test_path", "secret_before", "assigned",
    "checksum_before", "words_after",
)


def features(candidate: Column, path: Column, before: Column, after: Column) -> Column:
    """An array of ``FEATURES`` for one candidate."""
    size = F.length(candidate)
    low = F.lower(candidate)
    without = lambda text, pattern: F.length(F.regexp_replace(text, pattern, ""))
    share = lambda pattern: (size - without(candidate, pattern)) / size
    kinds = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(candidate, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"
    )
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    letter_runs = F.array_max(F.transform(F.split(low, "[^a-z]+"), lambda x: F.length(x)))
    letters = F.greatest(size - without(low, "[a-z]"), F.lit(1))
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    return F.array(
        size.cast("double"),
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        share("[^A-Za-z0-9]"),
        share("[0-9a-f]"),
        (runs - 1) / (size - 1),
        letter_runs / size,
        (size - without(low, "[aeiou]")) / letters,
        F.size(F.array_distinct(F.split(candidate, ""))) / F.least(size, F.lit(40)),
        (size - without(low, "(?:" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")")) / size,
        flag(candidate.rlike(r"^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk[-_]|pk_live|AIza|eyJ|npm_|SG\.)")),
        flag(low.rlike(r"example|placeholder|changeme|your[-_]|dummy|sample|xxxx|1234567|abcdef|(.)\1{5}")),
        flag(F.lower(path).rlike(r"test|example|sample|mock|fixture|docs?/|lock|\.sum|\.min\.")),
        flag(
            before.rlike(
                r"(?i)(secret|token|passw|pwd|api[-_ ]?key|apikey|auth|bearer|credential|access[-_ ]?key|private)"
                r"[^\n]{0,16}$"
            )
        ),
        flag(before.rlike(r"[=:]\s*[\"']?$")),
        flag(before.rlike(r"(?i)(commit|sha\d*|md5|checksum|hash|digest|uuid|guid|revision|integrity|etag)\W{0,4}$")),
        flag(after.rlike(r"^[\"']?[\s,;.)]*[A-Za-z]{2,}")),
    )


# --- labelled findings ------------------------------------------------------------------------


def labelled_findings(rows: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """``path``, text before, candidate, text after and whether the finding is a secret."""
    draw = random.Random(seed)
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, n: "".join(draw.choice(chars) for _ in range(n))
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(2, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))

    def camel(n: int) -> str:
        return "".join(draw.choice(DICTIONARY).title() for _ in range(n))

    def uuid() -> str:
        return "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12))

    secrets = (
        lambda: some(hexes, draw.choice([32, 40, 40, 48, 64])),
        lambda: some(alnum, draw.randint(20, 48)),
        lambda: some(alnum + "+/", draw.choice([40, 44, 64])) + draw.choice(["", "=", "=="]),
        lambda: some(alnum + "_-", draw.randint(24, 43)),
    )
    branded = (
        lambda: "AKIA" + some(alnum[:26] + "234567", 16),
        lambda: "ghp_" + some(alnum, 36),
        lambda: "xoxb-" + some("0123456789", 12) + "-" + some(alnum, 24),
        lambda: "sk_live_" + some(alnum, 24),
        lambda: "AIza" + some(alnum + "_-", 35),
        lambda: "eyJ" + some(alnum, 30) + "." + some(alnum, 40) + "." + some(alnum + "_-", 43),
    )
    harmless = (
        lambda: camel(draw.randint(3, 5)),
        lambda: "_".join(draw.choice(DICTIONARY) for _ in range(draw.randint(3, 5))),
        lambda: "/".join(draw.choice(DICTIONARY) for _ in range(draw.randint(3, 6))) + ".py",
        lambda: some("0123456789", draw.randint(16, 20)),
        lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(8, 14))),
        lambda: word() + ".example.com/" + word() + "/" + word(),
        lambda: ".".join(some("0123456789", draw.randint(1, 3)) for _ in range(4)) + "." + some("0123456789", 8),
        lambda: "-" * draw.randint(16, 40),
        lambda: "=" * draw.randint(16, 40),
    )
    placeholders = (
        lambda: "your-" + draw.choice(["api", "secret", "access"]) + "-key-goes-here",
        lambda: "EXAMPLE" + some(alnum, 14) + "EXAMPLE",
        lambda: "x" * draw.randint(16, 40),
        lambda: "changeme" + "-placeholder" + some("0123456789", 3),
        lambda: "0123456789abcdef" * draw.randint(1, 2),
    )
    keyword = lambda: draw.choice(
        ["token", "api_key", "API_KEY", "secret", "password", "auth_token", "access_key", "client_secret", "Bearer"]
    )
    joint = lambda: draw.choice([' = "', "=", ": ", ' : "', "='", ": '", '="', " "])
    benign = lambda: draw.choice(["commit ", "sha256:", "md5 = ", "checksum: ", "uuid=", "etag: ", "digest "])
    plain_path = lambda: draw.choice(["src0", "web", "app/settings.py", "src/main.go", "config.yaml", "notes.txt"])
    test_path = lambda: draw.choice(["tests/data.py", "package-lock.json", "go.sum", "docs/example.md"])
    made = []
    for k in range(rows):
        left, right = prose(draw.randint(0, 6)), draw.choice(['" ', "' ", " ", "\n", ""]) + prose(draw.randint(0, 5))
        kind = k % 8
        if kind in (0, 1, 2):
            row = (plain_path(), f"{left} {keyword()}{joint()}", draw.choice(secrets)(), right, 1)
        elif kind == 3:
            row = (plain_path(), f"{left} ", draw.choice(branded)(), right, 1)
        elif kind == 4:
            row = (plain_path(), f"{left} {benign()}", draw.choice((secrets[0], uuid))(), right, 0)
        elif kind == 5:
            row = (plain_path(), f"{left} ", draw.choice(harmless)(), right, 0)
        elif kind == 6:
            row = (plain_path(), f"{left} {keyword()}{joint()}", draw.choice(placeholders + harmless[:4])(), right, 0)
        else:
            row = (test_path(), f"{left} {draw.choice([keyword() + joint(), benign(), ''])}",
                   draw.choice((secrets[0], uuid, *harmless))(), right, 0)
        made.append(row)
    return made


def findings_frame(spark: SparkSession, rows: Sequence[tuple[str, str, str, str, int]]) -> DataFrame:
    """Labelled findings with their ``features``."""
    table = spark.createDataFrame(list(rows), "path string, before string, candidate string, after string, label int")
    columns = [F.col(c) for c in ("candidate", "path", "before", "after")]
    return table.withColumn("features", features(*columns))


@functools.cache
def trained_forest(spark: SparkSession) -> tuple[Node, ...]:
    """The forest; runs one job over the ``FINDINGS`` labelled rows."""
    rows = findings_frame(spark, labelled_findings()).select("features", "label").collect()
    x = np.array([row["features"] for row in rows])
    y = np.array([row["label"] for row in rows], float)
    return tuple(grow_forest(x, y, trees=TREES, depth=DEPTH, seed=SEED))


def forest_column(forest: Sequence[Node], row: Column) -> Column:
    """The mean share of a forest for an array of features, as nested conditions."""
    votes = [
        fold(
            tree,
            F.lit,
            lambda f, limit, low, high: F.when(F.get(row, F.lit(f)) <= limit, low).otherwise(high),
        )
        for tree in forest
    ]
    return functools.reduce(lambda a, b: a + b, votes) / len(votes)


# --- scan -------------------------------------------------------------------------------------


def candidates(text: Column, path: Column, forest: Sequence[Node], threshold: float) -> Column:
    """The pieces of a text as structs, the first one without a candidate."""
    clean = F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, "  ")
    pieces = F.split(F.regexp_replace(clean, _CANDIDATE, f"{_OPEN}$1{_CLOSE}"), _OPEN)
    none = "struct<start:int,secret:string,probability:double,is_secret:boolean,rest:string>"

    def one(all_: Column, piece: Column, k: Column) -> Column:
        found = F.substring_index(piece, _CLOSE, 1)
        rest = F.substring(piece, F.length(found) + 2, F.length(piece))
        before = F.substring_index(F.get(all_, k - 1), _CLOSE, -1)
        row = features(
            found,
            path,
            F.substring(before, F.greatest(F.length(before) - CONTEXT_CHARS + 1, F.lit(1)), F.lit(CONTEXT_CHARS)),
            F.substring(rest, 1, CONTEXT_CHARS),
        )
        scored = let(row, lambda r: forest_column(forest, r))
        return let(
            F.struct(found.alias("secret"), rest.alias("rest"), scored.alias("p")),
            lambda x: F.struct(
                (F.length(x["secret"]) + F.length(x["rest"])).alias("length"),
                x["secret"].alias("secret"),
                x["p"].alias("probability"),
                (x["p"] > threshold).alias("is_secret"),
                x["rest"].alias("rest"),
            ),
        )

    first = F.struct(
        F.length(F.get(pieces, F.lit(0))).alias("length"),
        F.lit(None).cast("string").alias("secret"),
        F.lit(None).cast("double").alias("probability"),
        F.lit(False).alias("is_secret"),
        F.get(pieces, F.lit(0)).alias("rest"),
    )
    scored = let(
        pieces,
        lambda all_: F.transform(
            all_, lambda piece, k: F.when(k == 0, first).otherwise(one(all_, piece, k))
        ),
    )
    # Starts are running lengths; the accumulator keeps the position and the list so far.
    placed = F.aggregate(
        scored,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{none}>").alias("done")),
        lambda a, x: F.struct(
            (a["at"] + x["length"]).alias("at"),
            F.array_append(
                a["done"],
                F.struct(
                    a["at"].alias("start"),
                    x["secret"].alias("secret"),
                    x["probability"].alias("probability"),
                    x["is_secret"].alias("is_secret"),
                    x["rest"].alias("rest"),
                ),
            ).alias("done"),
        ),
        lambda a: a["done"],
    )
    return placed


def scan(
    docs: DataFrame,
    *,
    text: str = "text",
    path: str | None = "source",
    keep: Sequence[str] = ("doc_id",),
    threshold: float = THRESHOLD,
    redacted: str = "redacted",
) -> DataFrame:
    """``keep`` columns, ``findings`` (start, secret, probability, is_secret) and the redacted text.

    ``start`` counts code points from 0.
    """
    forest = trained_forest(docs.sparkSession)
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    whole = F.array(candidates(F.col(text), where, forest, threshold))
    # A generator's output is never copied into later expressions, so each text is scanned once.
    scanned = docs.select(*keep, F.col(text).alias("_text"), F.explode(whole).alias("_all"))
    clean = F.array_join(
        F.transform(
            "_all",
            lambda x: F.concat(
                F.when(x["is_secret"], F.lit(REDACTED)).otherwise(F.coalesce(x["secret"], F.lit(""))), x["rest"]
            ),
        ),
        "",
    )
    return scanned.select(
        *keep,
        F.transform(
            F.filter("_all", lambda x: x["secret"].isNotNull()),
            lambda x: F.struct(x["start"], x["secret"], x["probability"], x["is_secret"]),
        ).alias("findings"),
        F.when(F.exists("_all", lambda x: x["is_secret"]), clean).otherwise(F.col("_text")).alias(redacted),
    )


def findings(docs: DataFrame, **options) -> DataFrame:
    """One row for every candidate: ``doc_id``, ``start``, ``secret``, ``probability``, ``is_secret``."""
    return scan(docs, **options).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*")
