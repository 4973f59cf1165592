"""Operator 8 [native]: secret scans, with a random forest that removes false findings.

Candidates are words of eight characters or more with a digit, sixteen capitals in a row or many changes
of case, addresses with credentials, heads of private keys, and all values that a secret's name is set to,
whatever their length and characters, also several in one word. Each is described by its length, changes
of character class and share of classes, how much of it a dictionary of the corpus' own words covers, its
path, and the words beside it (whether the dictionary has them, and which they are, hashed). A forest
that has learnt from labelled findings scores candidates; those below the threshold are false and go.
Everything is DataFrame functions and the forest of pyspark.ml, which runs in the JVM.

Labels are people's, joined by document and value (``marked``), or else those that forms and names make
sure of (``by_format``). The forest never sees names, signs of assignment or formats, which those go by.

Words are counted over all texts (partial sums before the shuffle); the dictionary is the most
frequent ones, a bounded table. Training takes a bounded sample of the labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Bounds: words of the dictionary, labelled findings to learn from (about), trees and their depth.
DICTIONARY, SAMPLE, TREES, DEPTH = 20_000, 20_000, 20, 6
#: Places that the words beside a candidate are hashed into.
BESIDE = 64

_SPACES = r"[ \t\n\x0B\f\r]+"
_EDGES = rf"^{_SPACES}|(?<![ \t\n\x0B\f\r]){_SPACES}$"
_CANDIDATE = r"[0-9]|[A-Z]{16}|(\p{Ll}{1,16}\p{Lu}{1,16}){4}"
#: Words that announce a secret, words and paths that announce an example.
KEYWORDS = r"(?i)pass(word|wd|phrase)?|pwd|(?<!\p{L})pw(?!\p{L})|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private"
EXAMPLES = r"(?i)example|sample|dummy|fake|placeholder|changeme|your[_-]|xxxx|test"

#: Names that hold nothing but secrets; values that stand for one.
SURE = r"(?i)(pass(word|wd|phrase)|(^|[^\p{L}])pass|(^|[^\p{L}])pw|pwd|secret|token|(api|access|private|auth|secret)[_-]?key|credentials?)[\"'`]?$"
_HOLDERS = r"(?i)^(example|sample|dummy|fake|placeholder|change_?me|your[_-]\w*|test|null|none|nil|undefined|true|false|string|[*x.]+|<.*>|\$?\{.*\}?|\$[a-z_]+|%[a-z_]+%)$"
#: Formats of issuers, and an address with a user's password.
ISSUED = r"^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|xox[abeoprs]-[\w\-]{10,}|[srp]k_(live|test)_[0-9A-Za-z]{16,}|sk-[\w\-]{20,}|AIza[\w\-]{35}|SG\.[\w\-]{16,}\.[\w\-]{16,}|npm_[0-9A-Za-z]{36}|pypi-[\w\-]{16,}|hf_[0-9A-Za-z]{30,}|ya29\.[\w\-]{20,}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]*)$"
_ISSUED = r"(?<![\p{L}\p{N}_\-])" + ISSUED[1:-1] + r"(?![\p{L}\p{N}_\-])"
_WITH_USER = r"\p{L}[\p{L}\p{N}+.\-]{0,30}://[^/\s:@]{0,500}:[^/\s@]{1,500}@[^\s\"'`,;]+"
#: Bounded, as are the other repetitions that a match may begin with: very long words stay linear work.
_NAME = r"[\p{L}_][\p{L}\p{N}_.\-]{0,100}"
#: A name, what sets it, and (looked at only, so that the next name may be in it) its value.
_PART = rf"({_NAME})[\"'`]?\]?(?:=>|:=|==?|:(?!//))(?=(\"[^\"]*\"|'[^']*'|[^\s\"'`,;&{{}}]+))"
#: The same, and what it is set to.
_SET = rf"{_NAME}[\"'`]?\]?(?:=>|:=|==?|:(?!//))(?:\"[^\"]*\"|'[^']*'|[^\s\"'`,;&{{}}]+)"
_SETS = "[=:]>?[\"'`]?$"
_FLAG = rf"^--?{_NAME}$"

FEATURES = ["length", "changes", "digits", "uppers", "lowers", "signs", "distinct", "covered", "before_known", "after_known", "before_length", "after_length", "path_example", "path_depth"]
_NEAR = ["before_word", "after_word"]
#: Characters of a word beside a candidate that are looked at: a very long word isn't repeated with all its candidates.
REACH = 200
#: White space that a quoted value may have, and what stands for it (characters that no text has) while words are split.
_BLANKS, _MARKS = " \t\x0B\f\r", "\uFDD0\uFDD1\uFDD2\uFDD3\uFDD4"
#: What stands before a secret's quoted value.
_TELLS = rf"({KEYWORDS})[\w.\-]{{0,50}}[\"'`]?\]?\s{{0,20}}(=>|:=|==?|:)\s{{0,20}}$"
_PEM = "^KEY-----"


def announced(before2: Column, before: Column) -> Column:
    """Whether the words before name a secret that is set to what follows: ``pwd: x``, ``pwd = x``, ``--pwd x``, ``Bearer x``."""
    sign = before.isin("=", ":", ":=", "=>", "==") & before2.rlike(KEYWORDS)
    return sign | (before.rlike(KEYWORDS) & (before.rlike(_SETS) | before.rlike(_FLAG))) | before.rlike("(?i)^[\"'`]?bearer$")


def quoted(body: Column) -> Column:
    """A text with the white space within the quoted value of a secret's name replaced, so that the value is one word.

    A value goes to the closing quote of its line. Pieces between quotes are looked at one by one: those after
    a sign that a secret's name stands before, with something behind the closing quote or the text's end.
    """
    tail = lambda x: F.coalesce(F.substring(x, -REACH, REACH), F.lit(""))
    for quote in ('"', "'"):
        pieces, none = F.split(body, quote), F.lit("")
        # Each piece with its neighbours, so that a long text is split once and not for each of its pieces.
        beside = F.arrays_zip(pieces.alias("it"), F.concat(F.array(none), pieces).alias("before"), F.concat(F.array(none, none), pieces).alias("before2"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("after"))
        told = lambda x: F.concat(tail(x["before2"]), F.lit(quote), tail(x["before"])).rlike(_TELLS)  # noqa: B023, E731
        held = lambda x: x["after"].isNotNull() & x["it"].rlike(f"[{_BLANKS}]") & ~x["it"].contains("\n") & told(x)  # noqa: B023, E731
        kept = F.transform(F.filter(beside, lambda x: x["it"].isNotNull()), lambda x: F.when(held(x), F.translate(x["it"], _BLANKS, _MARKS)).otherwise(x["it"]))  # noqa: B023
        body = F.when(body.rlike(KEYWORDS) & body.contains(quote), F.array_join(kept, quote)).otherwise(body)
    return body


def candidates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, path, place, before2, before, after, name, value): each candidate of each text.

    ``place`` counts words (split at the six ASCII spaces; a secret's quoted value is one word) from 0; a word
    may have several candidates, each value once. A private key's head gives the name ``pem``. ``value`` is what
    stands after a sign that follows a name, without quotes and punctuation at its ends (a secret's keeps all but
    quotes, brackets and what ends a clause), ``name`` what stands before it. The words around are given up to
    REACH characters on the candidate's side. Null texts have none; repeated rows have candidates of their own.
    """
    body = docs[text].cast("string")
    words = F.split(F.regexp_replace(quoted(body), _EDGES, ""), _SPACES)
    shapes = body.rlike(_CANDIDATE) | body.rlike(KEYWORDS) | body.rlike(_WITH_USER) | body.contains("PRIVATE KEY-----") | body.rlike(_ISSUED)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), docs[id_col].alias("id"), (docs[path].cast("string") if path else F.lit(None).cast("string")).alias("path"), words.alias("w"), shapes.alias("_any")).where("_any")
    shaped = lambda x: ((F.length(x) >= 8) & x.rlike(_CANDIDATE)) | x.rlike(_ISSUED)
    beside = lambda k: F.coalesce(F.get("w", k), F.lit(""))
    wanted = lambda x, i: shaped(x) | (x.rlike("[=:]") & (x.rlike(KEYWORDS) | x.rlike(_WITH_USER))) | announced(beside(i - 2), beside(i - 1)) | (x.rlike(_PEM) & (beside(i - 1) == "PRIVATE"))
    at = F.filter(F.transform("w", lambda x, i: F.when(wanted(x, i), i)), lambda i: i.isNotNull())
    each = rows.select("_row", "id", "path", "w", F.explode(at).alias("place"))
    near = lambda k: beside(F.col("place") + k)
    last = lambda x: F.when(F.length(x) > REACH, F.substring(x, -REACH, REACH)).otherwise(x)
    each = each.select("_row", "id", "path", "place", near(0).alias("word"), *(F.translate(x, _MARKS, _BLANKS).alias(c) for c, x in (("before2", last(near(-2))), ("before", last(near(-1))), ("after", F.substring(near(1), 1, REACH)))))
    trimmed = lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]+$", "")
    secret = lambda x: F.regexp_replace(x, r"^[\"'`(\[{<]+|(?<![\"'`)\]}>,;.:])[\"'`)\]}>,;.:]+$", "")
    of = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    word, blank = F.col("word"), F.lit("")
    plain = F.regexp_replace(word, _WITH_USER, " ")  # an address is a value as a whole
    bare = trimmed(plain)
    own = F.regexp_extract(plain, rf"^[^\p{{L}}\p{{N}}_]*({_NAME})[\"'`]?\]?(?:=>|:=|==?|:(?!//))", 1)
    rest = F.regexp_replace(plain, rf"^[^\p{{L}}\p{{N}}_]*{_NAME}[\"'`]?\]?(?:=>|:=|==?|:)", "")
    # All that follows the first name, for a secret may have the signs that end a part; not where more names follow.
    whole = own.rlike(KEYWORDS) & ~rest.rlike(rf"[,;&{{]\W{{0,20}}{_NAME}[\"'`]?[=:]")
    one = F.when(~F.coalesce(whole, F.lit(False)) & ~plain.rlike(_PART) & shaped(bare), F.array(of(blank, bare)))
    set_to = F.when(whole, F.array(of(own, secret(rest))))
    follows = F.when(announced(F.col("before2"), F.col("before")), F.array(of(blank, secret(word))))
    parts = F.arrays_zip(F.regexp_extract_all(plain, F.lit(_PART), F.lit(1)).alias("name"), F.regexp_extract_all(plain, F.lit(_PART), F.lit(2)).alias("value"))
    cut = F.transform(parts, lambda p: of(p["name"], F.when(p["name"].rlike(KEYWORDS), secret(p["value"])).otherwise(trimmed(p["value"]))))
    cut = F.when(~F.coalesce(whole, F.lit(False)), F.filter(cut, lambda p: p["name"].rlike(KEYWORDS) | shaped(p["value"])))
    loose = F.transform(F.split(F.regexp_replace(plain, _SET, " "), r"[\s\"'`,;&{}=]+"), lambda x: of(blank, trimmed(x)))
    loose = F.when(plain.rlike(_PART) & ~F.coalesce(whole, F.lit(False)), F.filter(loose, lambda p: shaped(p["value"])))
    users = F.transform(F.regexp_extract_all(word, F.lit(_WITH_USER), F.lit(0)), lambda u: of(blank, trimmed(u)))
    pem = F.when(word.rlike(_PEM) & (F.col("before") == "PRIVATE"), F.array(of(F.lit("pem"), F.lit("PRIVATE KEY-----"))))
    none = F.array().cast("array<struct<name:string,value:string>>")
    found = F.concat(*(F.coalesce(x, none) for x in (one, set_to, follows, cut, loose, users, pem)))
    around = ["id", "path", "before2", "before", "after"]
    each = each.select("_row", "place", *around, F.explode(found).alias("_c")).select("_row", "place", *around, "_c.name", F.translate("_c.value", _MARKS, _BLANKS).alias("value"))
    # One value of a word is one candidate, by the name if it has one: told apart by rows, not within an array of the word's parts.
    each = each.where("length(value) > 0").groupBy("_row", "place", "value").agg(*(F.first(c).alias(c) for c in around), F.max("name").alias("name"))
    return each.select("id", "path", "place", "before2", "before", "after", "name", "value")


def dictionary(docs: DataFrame, text: str = "text", most: int = DICTIONARY) -> DataFrame:
    """(known): the most frequent words of 3 letters or more, lower-cased, of all texts; ``most`` of them or less.

    Counts are cut into sixteenths of a doubling, and words of as many of these from the top as fit are
    taken: so no task sorts all words, and words of like frequency stay or go together. At 20,000 words a
    rarer one only lacks its share in the features of what the dictionary covers.
    """
    each = docs.select(F.explode(F.regexp_extract_all(F.lower(docs[text].cast("string")), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("known"))
    counts = saved(each.groupBy("known").agg(F.floor(F.log2(F.count("*")) * 16).cast("int").alias("level")), "words")
    levels = sorted(((r.level, r.n) for r in counts.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)
    least = levels[0][0] + 1 if levels else 0
    for level, n in levels:
        most -= n
        if most < 0:
            break
        least = level
    return counts.where(F.col("level") >= least).select("known")


def described(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with the columns FEATURES, all doubles, and the words beside them."""
    bare = lambda c: F.regexp_extract(F.lower(c), r"\p{L}[\p{L}_\-]*", 0)
    numbered = saved(found.withColumns({"_n": F.monotonically_increasing_id(), "before_word": bare("before"), "after_word": bare("after")}), "candidates")
    letters = lambda c, what: F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{3,}"), F.lit(0)), lambda w: F.struct(F.lit(what).alias("what"), w.alias("known")))
    parts = numbered.select("_n", F.explode(F.concat(letters("value", "v"), letters("before_word", "b"), letters("after_word", "a"))).alias("p")).select("_n", "p.what", "p.known")
    of = lambda what: F.sum(F.when(F.col("what") == what, F.length("known")))
    covered = parts.join(F.broadcast(known), "known").groupBy("_n").agg(of("v").alias("_v"), of("b").alias("_b"), of("a").alias("_a"))
    v, n = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    classes = v
    for pattern, one in (("[0-9]+", "0"), (r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), ("[^0aA]+", ".")):
        classes = F.regexp_replace(classes, pattern, one)
    path = F.coalesce("path", F.lit(""))
    made: dict[str, Column] = {
        "length": n, "changes": F.length(classes) - 1, "digits": share("[0-9]"), "uppers": share(r"\p{Lu}"), "lowers": share(r"\p{Ll}"), "signs": share(r"[^\p{L}\p{N}]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n, "covered": F.coalesce("_v", F.lit(0)) / n,
        "before_known": (F.coalesce("_b", F.lit(0)) > 0), "after_known": (F.coalesce("_a", F.lit(0)) > 0), "before_length": F.length("before"), "after_length": F.length("after"),
        "path_example": path.rlike(EXAMPLES), "path_depth": F.regexp_count(path, F.lit("/")),
    }
    return numbered.join(covered, "_n", "left").select(*found.columns, *_NEAR, *(made[c].cast("double").alias(c) for c in FEATURES))


def marked(findings: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "label") -> DataFrame:
    """Described findings with people's labels (id, value, label); null where there is none.

    A finding with both labels counts as unknown.
    """
    told = labels.groupBy(labels[id_col].alias("id"), "value").agg(F.min(label).alias("label"), F.max(label).alias("_most"))
    told = told.select("id", "value", F.when(F.col("label") == F.col("_most"), F.col("label")).cast("int").alias("label"))
    return findings.join(told, ["id", "value"], "left")


def _vectors(rows: DataFrame) -> DataFrame:
    hashed = FeatureHasher(inputCols=_NEAR, outputCol="_beside", numFeatures=BESIDE).transform(rows)
    return VectorAssembler(inputCols=[*FEATURES, "_beside"], outputCol="features").transform(hashed)


def learn(labelled: DataFrame, label: str = "label", sample: int = SAMPLE, seed: int = 8) -> RandomForestClassificationModel | None:
    """A forest from described findings with a label of 0 or 1; about ``sample`` of them, by hash.

    None where there are no findings, or only of one label: then nothing can be told apart.
    """
    rows = labelled.where(F.col(label).isin(0, 1))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if len(counts) < 2:
        return None
    spot = F.shiftrightunsigned(F.xxhash64("id", "place", "value"), 11) / float(1 << 53)
    few = rows.where(spot < min(1.0, sample / sum(counts.values()))).select(*FEATURES, *_NEAR, F.col(label).cast("double").alias("label"))
    few = saved(few.orderBy(*FEATURES, *_NEAR, "label"), "labelled")  # an order of their own, so that reruns agree
    if few.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featuresCol="features", labelCol="label")
    return forest.fit(_vectors(few))


def scored(findings: DataFrame, model: RandomForestClassificationModel | None, name: str = "score") -> DataFrame:
    """Described findings with the forest's share of votes for a secret; 1 without a model, so that none is lost."""
    if model is None:
        return findings.withColumn(name, F.lit(1.0))
    return model.transform(_vectors(findings)).withColumn(name, vector_to_array("probability")[1]).select(*findings.columns, name)


def evaluated(labelled: DataFrame, label: str = "label", threshold: float = 0.5, of: int = 5) -> dict[str, float]:
    """Precision and recall of a forest on every ``of``-th part of the labelled findings (by their ids'
    hashes) that it hasn't learnt from, with the numbers of true and false secrets there."""
    out = F.pmod(F.xxhash64("id"), F.lit(of)) == 0
    rows = labelled.where(F.col(label).isin(0, 1))
    found = scored(rows.where(out), learn(rows.where(~out), label)).select(F.col(label).alias("y"), (F.col("score") >= threshold).alias("p"))
    r = found.agg(F.count_if(F.expr("p and y = 1")).alias("hit"), F.count_if("p").alias("said"), F.count_if(F.expr("y = 1")).alias("true"), F.count_if(F.expr("y = 0")).alias("false")).first()
    return {"precision": r.hit / max(r.said, 1), "recall": r.hit / max(r.true, 1), "secrets": r.true, "others": r.false}


def by_format(value: Column, name: Column, before2: Column, before: Column) -> Column:
    """Labels of findings by form, where there are no people's: 1 for issuers' formats, addresses with
    credentials, and values that a secret's name is set to (of letters in one case only from 12 on; shorter
    ones may be prose); 0 for what stands for a secret, and for addresses, numbers and plain words that no
    such name is set to; null where unknown."""
    set_to = announced(before2, before)
    named = name.rlike(KEYWORDS) | set_to
    sure = name.rlike(SURE) | (set_to & F.when(before.isin("=", ":", ":=", "=>", "=="), before2).otherwise(F.regexp_replace(before, _SETS, "")).rlike(SURE))
    holder = value.rlike(_HOLDERS)
    word = value.rlike(r"^(\p{Lu}?\p{Ll}*|\p{Lu}+)$") & (F.length(value) < 12)
    secret = value.rlike(ISSUED) | value.rlike(f"^{_WITH_USER}") | (name == "pem") | (named & value.rlike("^(?i)[0-9a-f]{16,}$"))
    plain = value.rlike(r"^[^@:/=]+@[^@:/=]+$") | value.rlike(r"^[0-9.,\-+() /]+$") | value.rlike(r"^\p{L}+[0-9]{1,3}$")
    return F.when(secret, 1).when(holder, 0).when(sure & ~word, 1).when(~named & plain, 0)


def findings(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """All candidates, described, with ``label`` by their form: what ``secrets`` learns from if it has nothing better."""
    found = saved(described(candidates(docs, text, id_col, path), dictionary(docs, text)), "findings")
    return found.withColumn("label", by_format(F.col("value"), F.col("name"), F.col("before2"), F.col("before")))


def secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None, labels: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Findings that the forest takes for secrets: id, place, name, value, score, and the words around.

    ``labels`` are people's findings (id, value, label of 0 or 1); without them the corpus' own findings
    are labelled by form. Either way the forest decides on every finding, also on those that it has learnt from,
    and what scores below ``threshold`` goes. Null and
    empty texts have no findings, an empty table gives none; a null id stays null; repeated rows give
    repeated findings. Texts are scanned whole. Other columns are not read.
    """
    found = findings(docs, text, id_col, path)
    if labels is not None:
        found = marked(found.drop("label"), labels, id_col)
    kept = scored(found, learn(found)).where(F.col("score") >= threshold)
    return kept.select(F.col("id").alias(id_col), "place", "name", "value", "score", "before2", "before", "after")
