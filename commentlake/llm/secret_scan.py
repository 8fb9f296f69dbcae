"""Secret scan: candidate strings, and a random forest that drops false ones.

Candidates are runs of 16 or more characters of [A-Za-z0-9_+/-] with a digit or
a capital after the first character.  The forest sees their length, character
classes and transitions, how much of them a dictionary covers, path marks and
neighbouring words.  It is trained on labelled findings of the caller and then judges
all candidates.  Where the caller has none, findings are labelled by the shapes
below: formats that providers document, assignments to a credential's name and
passwords of addresses are secrets; plain numbers, plain words, identifiers of known
form and parts of paths and addresses are not, unless they are assigned to such a
name.  These labels stand; the forest learns from them without the features that the
shapes read (SHAPED) and judges the candidates that no shape knows.

Shorter secrets, and those with other characters, are no candidates.

All work on texts and findings is done by DataFrame functions; the trained trees
become one conditional expression, so texts can be redacted in a projection.

Defined results: a null or empty text has no findings; a candidate that occurs
twice is two findings; without labelled findings of both kinds there is no
forest and the shapes alone decide; an empty table has no findings and an empty
dictionary; other columns pass through untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_by_hash, fresh, stored, table

#: Bounds of what is fitted: labelled findings, words of the dictionary.
TRAIN_FINDINGS, DICTIONARY_WORDS = 20_000, 5_000
TREES, DEPTH = 15, 6
MASK = "[SECRET]"

_CHARS = "A-Za-z0-9_+/\\-"
CORE = f"(?<![{_CHARS}])(?=[{_CHARS}]*[0-9]|[{_CHARS}]+[A-Z])[{_CHARS}]{{16,}}+={{0,2}}"
BLANK = r"[\x20\x09-\x0D]+"

# fixed values: documented credential formats and names
PROVIDER = (r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^github_pat_|^xox[abprs]-|^sk-[A-Za-z0-9_-]{20,}"
            r"|^AIza[0-9A-Za-z_-]{35}$|^glpat-|^eyJ[A-Za-z0-9_-]{10,}")
NAME = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|auth)"
PLAIN = (r"^[0-9+/-]+$|^[A-Za-z_-]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[A-Za-z]+[0-9]{1,4}$"
         r"|^[0-9]{4}-[0-9]{2}-[0-9]{2}")
ADDRESS = r"@|://|www\."
LOCATION = rf"{ADDRESS}|/.*/"                       # a path or an address
PATH_START = r"^([.~]{0,2}/|[A-Za-z]:\\)"
#: What stands before a value assigned in the same word, before the password of an address, and after that.
KEY = NAME + r"[A-Za-z0-9_.-]{0,24}[\"']?[=:][\"']?$"
USER, HOST, PORT = r"://[^/@\s]*:[^/@\s]*$", r"^[^/\s]*@", r"^[0-9]{1,5}(/|$)"

FEATURES = ["length", "digits", "uppers", "lowers", "others", "transitions", "repeats", "distinct", "hex",
            "vowels", "dictionary", "slashes", "path", "address", "named", "assigned", "quoted", "near_word", "format", "password"]


SHAPED = ("path", "address", "named", "assigned", "format", "password")


def candidates(text: Column, words: Column) -> Column:
    """Array of (core, word, prev1, prev2, next) of a text; ``words`` is the
    text parted at BLANK."""
    at = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(CORE), i)), lambda i: i.isNotNull())

    def one(i: Column) -> Column:
        near = lambda d: F.coalesce(F.get(words, i + d), F.lit(""))
        return F.transform(F.regexp_extract_all(F.get(words, i), F.lit(CORE), 0), lambda core: F.struct(
            core.alias("core"), F.get(words, i).alias("word"), near(-1).alias("prev1"), near(-2).alias("prev2"),
            near(1).alias("next")))

    return F.flatten(F.transform(at, one))


def with_candidates(docs: DataFrame, out: str) -> DataFrame:
    """``docs`` with an array of candidates, null for a text without any."""
    words = fresh("_words", docs.columns)
    parted = docs.withColumn(words, F.when(F.col("text").rlike(CORE), F.split("text", BLANK)))
    return parted.withColumn(out, F.when(F.col(words).isNotNull(), candidates(F.col("text"), F.col(words)))).drop(words)


def lead_of(c: Column) -> Column:
    """What stands before the candidate in its own word."""
    return F.substr(c["word"], F.lit(1), F.position(c["core"], c["word"]) - 1)


def password(c: Column) -> Column:
    """Whether the candidate is the SECRET of scheme://user:SECRET@host."""
    rest = F.substr(c["word"], F.position(c["core"], c["word"]) + F.length(c["core"]))
    return lead_of(c).rlike(USER) & rest.rlike(HOST) & ~c["core"].rlike(PORT)


def features(c: Column, dictionary: str) -> list[Column]:
    """FEATURES of one candidate struct; ``dictionary``: words between blanks."""
    core, n = c["core"], F.length(c["core"])
    count = lambda pattern, of=core: F.regexp_count(of, F.lit(pattern))
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    share = lambda k: k / n
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.regexp_extract_all(core, F.lit("([A-Z]?[a-z]{3,}|[A-Z]{4,})"), 1)
    known = F.aggregate(runs, F.lit(0), lambda acc, r: acc + F.when(
        F.lit(dictionary).contains(F.concat(F.lit(" "), F.lower(r), F.lit(" "))), F.length(r)).otherwise(0))
    lead = lead_of(c)
    before = F.concat_ws(" ", c["prev2"], c["prev1"], lead)
    out = {
        "length": n.cast("double"), "digits": share(count("[0-9]")), "uppers": share(count("[A-Z]")),
        "lowers": share(count("[a-z]")), "others": share(count("[^A-Za-z0-9]")),
        "transitions": share(count("a(?=[^a])|A(?=[^A])|0(?=[^0])", kind)), "repeats": share(count(r"(.)(?=\1)")),
        "distinct": share(F.size(F.array_distinct(F.split(core, "")))),
        "hex": flag(core.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "vowels": share(count("[aeiouAEIOU]")),
        "dictionary": share(known), "slashes": count("/").cast("double"),
        "path": flag(c["word"].rlike(r"^[\"'(]?([.~]{0,2}/|[A-Za-z]:\\)|/.*/|\.[a-z]{2,4}$")),
        "address": flag(c["word"].rlike(r"@|://|www\.")), "named": flag(before.rlike(NAME)),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")), "quoted": flag(lead.rlike("[\"'`]$")),
        "near_word": flag(F.lit(dictionary).contains(F.concat(F.lit(" "), F.lower(c["prev1"]), F.lit(" ")))),
        "format": flag(core.rlike(PROVIDER)), "password": flag(password(c)),
    }
    return [out[f].cast("double").alias(f) for f in FEATURES]


def shape_label(c: Column) -> Column:
    """1 or 0 where a shape says so, else null."""
    lead = lead_of(c)
    before = F.concat_ws(" ", c["prev2"], c["prev1"], lead)
    assigned = before.rlike(NAME) & before.rlike(r"[=:]\s*[\"']?$")
    ambiguous = c["core"].rlike(PLAIN) | c["core"].rlike(PATH_START) | c["word"].rlike(ADDRESS)
    return (F.when(c["core"].rlike(PROVIDER), 1)
            .when(password(c) | lead.rlike(KEY) & ~c["core"].rlike(PLAIN) & ~c["core"].rlike(PATH_START), 1)
            .when(assigned, F.when(~ambiguous, 1))
            .when(c["core"].rlike(PLAIN) | c["word"].rlike(LOCATION), 0))


@dataclass(frozen=True)
class Scanner:
    """The fitted part: a dictionary and the trees, each a nested tuple
    (number in ``features``, threshold, tree up to it, tree above it) or a vote.
    ``shapes``: labels by shape stand, the trees judge the rest."""
    dictionary: str
    trees: tuple
    features: tuple = tuple(FEATURES)
    shapes: bool = False

    def score(self, c: Column) -> Column:
        """The share of trees that vote for a secret; ``c`` has FEATURES and label."""
        def column(t) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            return F.when(c[self.features[t[0]]] <= t[1], column(t[2])).otherwise(column(t[3]))
        known = c["label"].cast("double")
        if not self.trees:
            return F.coalesce(known, F.lit(0.0))
        total = column(self.trees[0])
        for t in self.trees[1:]:
            total = total + column(t)
        return F.coalesce(known, total / len(self.trees)) if self.shapes else total / len(self.trees)


def parse_trees(text: str) -> tuple:
    """Trees from the description that Spark gives of a forest."""
    trees = []
    for part in re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", text)[1:]:
        lines = iter([x.strip() for x in part.strip().splitlines()])

        def node():
            line = next(lines)
            if m := re.match(r"Predict: (\S+)", line):
                return float(m[1])
            m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
            low = node()
            next(lines)                                         # the matching Else
            return int(m[1]), float(m[2]), low, node()

        trees.append(node())
    return tuple(trees)


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, c): one row per candidate of ``docs``."""
    out = fresh("_found", docs.columns)
    return with_candidates(docs.select("doc_id", "text"), out).select("doc_id", F.posexplode(out).alias("nth", "c"))


#: Classes of word counts to a doubling.
COUNT_CLASSES = 32


def dictionary_of(docs: DataFrame) -> str:
    """The words of 4 or more letters that most of all documents have, at most
    DICTIONARY_WORDS of them, blank-separated.  Word counts fall into COUNT_CLASSES
    classes to a doubling; the highest classes are taken that have so many words
    together, so the driver gets a row a class and the words themselves."""
    words = (docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,20})"), 1))).alias("w"))
             .groupBy("w").count().filter("count > 1")
             .select("w", F.floor(F.log2("count") * COUNT_CLASSES).alias("class")))
    words = stored(words, "secret-words")
    sizes = {r["class"]: r["count"] for r in words.groupBy("class").count().collect()}
    least, total = None, 0
    for c in sorted(sizes, reverse=True):
        total += sizes[c]
        if total > DICTIONARY_WORDS:
            break
        least = c
    if least is None:
        return " "
    chosen = words.filter(F.col("class") >= least).select("w").collect()
    return " " + "".join(w + " " for w in sorted(r["w"] for r in chosen))


def train(found: DataFrame, dictionary: str, shapes: bool) -> Scanner:
    """A forest on at most TRAIN_FINDINGS labelled findings, chosen by hash;
    ``found``: described findings.  ``shapes``: their labels come from the shapes."""
    names = tuple(f for f in FEATURES if not (shapes and f in SHAPED))
    rows = first_by_hash(found.filter("label IS NOT NULL").select("f.*", F.col("label").cast("double"), "doc_id", "nth"),
                         ["doc_id", "nth"], TRAIN_FINDINGS).drop("doc_id", "nth")
    rows = stored(rows, "secret-training")
    if rows.select("label").distinct().count() < 2:
        return Scanner(dictionary, (), names, shapes)
    data = VectorAssembler(inputCols=list(names), outputCol="features").transform(rows).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="onethird",
                                    maxMemoryInMB=64, subsamplingRate=0.8).fit(data)
    return Scanner(dictionary, parse_trees(forest.toDebugString), names, shapes)


def described(found: DataFrame, dictionary: str) -> DataFrame:
    return found.select("doc_id", "nth", F.col("c")["core"].alias("secret"),
                        F.struct(*features(F.col("c"), dictionary)).alias("f"), shape_label(F.col("c")).alias("label"))


def fit(docs: DataFrame, labelled: DataFrame | None = None) -> tuple[Scanner, DataFrame]:
    """The scanner, and the described findings of all ``docs`` (stored).  ``labelled``:
    (doc_id, nth, label) of findings that are known to be secrets (1) or not (0)."""
    dictionary = dictionary_of(docs)
    found = stored(described(stored(findings(docs), "secret-candidates"), dictionary), "secret-findings")
    if labelled is None:
        return train(found, dictionary, shapes=True), found
    known = found.drop("label").join(labelled.select("doc_id", "nth", "label"), ["doc_id", "nth"])
    return train(known, dictionary, shapes=False), found


def quality(scanner: Scanner, found: DataFrame, labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row (n, precision, recall) over the labelled findings (doc_id, nth, label)."""
    judged = scored(scanner, found).join(labelled.select("doc_id", "nth", F.col("label").alias("truth")), ["doc_id", "nth"])
    said, true = F.col("score") >= threshold, F.col("truth") == 1
    return judged.agg(F.count("*").alias("n"), F.try_divide(F.count_if(said & true), F.count_if(said)).alias("precision"),
                      F.try_divide(F.count_if(said & true), F.count_if(true)).alias("recall"))


def scored(scanner: Scanner, found: DataFrame) -> DataFrame:
    """Findings (doc_id, nth, secret, score): all candidates with their votes."""
    c = {k: F.col("f")[k] for k in FEATURES} | {"label": F.col("label")}
    return found.select("doc_id", "nth", "secret", scanner.score(c).alias("score"))


def whole(core: Column) -> Column:
    """A pattern of ``core`` as a whole candidate, not as a part of a longer one."""
    after = F.when(core.endswith("=="), "").when(core.endswith("="), "(?!=)").otherwise(f"(?![{_CHARS}=])")
    return F.concat(F.lit(f"(?<![{_CHARS}])\\Q"), core, F.lit("\\E"), after)


def redact(docs: DataFrame, scanner: Scanner, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every string that the forest calls a secret masked."""
    found, hit = fresh("_found", docs.columns), fresh("_hit", docs.columns)
    full = lambda c: F.struct(c["core"].alias("core"), shape_label(c).alias("label"), *features(c, scanner.dictionary))
    judged = with_candidates(docs, found).withColumn(hit, F.filter(
        F.transform(found, full), lambda c: scanner.score(c) >= threshold))
    masked = F.aggregate(F.array_distinct(F.col(hit)["core"]), F.col("text"),
                         lambda acc, s: F.regexp_replace(acc, whole(s), F.lit(MASK)))
    return judged.withColumn("text", F.when(F.size(hit) > 0, masked).otherwise(F.col("text"))).drop(found, hit)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanner, found = fit(table(spark, sf_dir, "documents"))
    return scored(scanner, found).select("doc_id", "nth", F.length("secret").alias("n_chars"),
                                         F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"), "score",
                                         (F.col("score") >= 0.5).alias("is_secret"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, secrets masked; n_chars follows the text."""
    scanner, _ = fit(docs)
    out = redact(docs, scanner)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
