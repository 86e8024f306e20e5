"""URL filter: rules by host and path; where none fits, words of the host and path
decide by naive Bayes.

1. Rules are grouped by host. A host's suffixes meet the rules of theirs, the
   longest that fits decides. Any number of rules will do.
2. Words of all pages' visible text are counted. Of each run of letters in a host
   or path, the stretches as long as any word meet the words; unigram Viterbi then
   splits it: the split of highest probability, letters of no word in runs of
   their own. Neither the words nor their length are limited, for each run of
   letters meets only the words that occur in it.
3. Multinomial naive Bayes with add-one smoothing is learned from all pages for
   which a rule decides, over whole tokens. Both verdicts are held equally likely
   beforehand: which pages rules cover says nothing of the others' shares.

Hosts and paths are judged once, however many pages have them. Joins have plain
exchanges on both sides, so adaptive execution splits a hot word, token or url; no
row is ever sent to the driver but four sums and the lengths that words have.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped, prepare, written

MARKUP = re.compile(r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|&\w+;")
LETTERS = re.compile(r"[a-z]+")
#: Runs of Latin letters, of digits, and of other letters.
TOKENS = r"[a-z]+|[0-9]+|[\p{L}\p{M}\p{N}&&[^a-z0-9]]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word: as many as a string can have.
LONGEST = 2**31 - 1
#: Stretches of a run of letters that are looked up at once.
STRETCHES = 100_000
#: A task that counts words hands them on when it holds so many.
HELD_WORDS = 500_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path after the first ://; both empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged_by_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """urls (u1, u2, host, path) with rule and verdict of the longest rule that
    fits; null if none does. rules: (verdict, host + path); a rule fits its host and
    all subdomains if the path starts with its path. Of equally long ones the
    longer host wins, then the later in the alphabet; of equal ones the last given."""
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    by_host = defaultdict(list)
    for text, said in {text: said for said, text in rules}.items():
        h, _, p = text.partition("/")
        by_host[h].append((len(text), len(h), text, said, "/" + p))
    fixed = urls.sparkSession.createDataFrame(
        [(h, sorted(found, reverse=True)) for h, found in by_host.items()],
        "suffix string, fit array<struct<size:int,hosts:int,rule:string,verdict:string,start:string>>")
    most = max(h.count(".") for h in by_host) + 1  # no suffix of more labels is a rule's host
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    # The rules of a host are in descending order: the first that fits is its best.
    best = F.get(F.filter("fit", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0))
    met = urls.select("u1", "u2", "path", F.explode(suffixes).alias("suffix")).join(fixed, "suffix").select("u1", "u2", best.alias("best"))
    chosen = met.groupBy("u1", "u2").agg(F.max("best").alias("best"))
    return urls.join(chosen, ["u1", "u2"], "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


class Segmenter:
    """Unigram Viterbi over a run of letters. counts: of the words that may stand in
    it; total: the sum of all words' counts."""

    def __init__(self, counts: dict[str, int], total: int):
        self.total = max(total, 1)
        self.cost = {w: -math.log(c / self.total) for w, c in counts.items()}
        self.sizes = sorted({len(w) for w in counts if len(w) <= LONGEST})

    def unknown(self, n: int) -> float:
        """Letters that are no known word: less likely than any word, and ten times less with each letter."""
        return math.log(self.total) + n * math.log(10.0)

    def split(self, name: str) -> list[str]:
        """The split of highest probability; of equally likely ones that with the
        longer last part. Letters of no word go in runs as long as may be."""
        best, back, at, run, since = [0.0], [0], self.cost.get, math.inf, 0
        first, letter = self.unknown(0), self.unknown(1) - self.unknown(0)
        for j in range(1, len(name) + 1):
            if best[j - 1] + first < run:  # a run of no word begins here rather than before
                run, since = best[j - 1] + first, j - 1
            run += letter
            options = [(run, since)] + [(best[j - n] + c, j - n) for n in self.sizes if n <= j and (c := at(name[j - n:j])) is not None]
            c, i = min(options)
            best.append(c), back.append(i)
        out, j = [], len(name)
        while j:
            out.append(name[back[j]:j])
            j = back[j]
        return out[::-1]


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n): how often each run of a-z stands in the pages' visible text, lower-cased."""

    def batch(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    def run(batches):
        c = Counter()
        for b in batches:
            for html in b.column(0).to_pylist():
                if html:
                    c.update(LETTERS.findall(MARKUP.sub(" ", html).lower()))
                    if len(c) > HELD_WORDS:
                        yield batch(c)
                        c = Counter()
        yield batch(c)

    return written(pages.select(F.col(html_col).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, parts): each name, a run of letters, split into words."""
    spark: SparkSession = names.sparkSession
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())  # words of n lengths have n * n / 2 letters at least
    if not sizes:
        return names.select("name", F.array("name").alias("parts"))

    def stretches(batches):
        for b in batches:
            for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n in sizes:
                    for i in range(0, len(name) - n + 1, STRETCHES):
                        found = list({name[j:j + n] for j in range(i, min(i + STRETCHES, len(name) - n + 1))})
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array(found, pa.string())], ["k", "word"])

    met = names.select(F.xxhash64("name").alias("k"), "name").mapInArrow(grouped(stretches, 50_000), "k long, word string").distinct().join(words, "word")
    # Names with the same hash only share their words' counts.
    listed = met.groupBy("k").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    both = names.withColumn("k", F.xxhash64("name")).join(listed, "k", "left").select("name", "words")

    def split(batches):
        for b in batches:
            parts = [Segmenter({w["word"]: w["n"] for w in found or []}, total).split(name) for name, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.list_(pa.string()))], ["name", "parts"])

    return both.mapInArrow(split, "name string, parts array<string>")


def tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """(u1, u2, token): the words of urls' hosts ("h:") and paths ("p:"); digits
    count by their number only."""
    lowered = urls.select("u1", "u2", F.explode(F.array(F.struct(F.lit("h:").alias("kind"), F.col("host").alias("text")), F.struct(F.lit("p:").alias("kind"), F.lower("path").alias("text")))).alias("x"))
    runs = written(lowered.select("u1", "u2", F.col("x.kind").alias("kind"), F.explode(F.regexp_extract_all(F.col("x.text"), F.lit(TOKENS), 0)).alias("name")), "runs")
    latin = F.col("name").rlike("^[a-z]")
    split = written(segmented(runs.where(latin).select("name").distinct(), words), "names")
    named = runs.where(latin).join(split, "name").select("u1", "u2", "kind", F.explode("parts").alias("part"))
    other = runs.where(~latin).select("u1", "u2", "kind", F.when(F.col("name").rlike("^[0-9]"), F.concat(F.lit("#"), F.length("name").cast("string"))).otherwise(F.col("name")).alias("part"))
    return named.unionAll(other).select("u1", "u2", F.concat("kind", "part").alias("token"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) for every row.

    verdict: the longest fitting rule's, else that of naive Bayes ("block" if
    p_block, the probability it gives, is over one half; "allow" otherwise, so
    also without evidence). p_block is null where a rule decided.

    A null url, or one without ://, has an empty host and path and is "allow", for
    want of evidence, if no rule fits the empty host. Null pages add no words. Null
    and repeated ids pass through, each row with its own verdict; rows with the
    same url have the same one. Urls of any length count whole. An empty table
    gives an empty table; without any page for which a rule decides, and without
    rules, all verdicts are "allow". Other columns are not read.
    """
    spark = pages.sparkSession
    prepare(spark)
    words = word_counts(pages, html_col)
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = written(rows.select("*", F.xxhash64("host", "path").alias("u1"), F.xxhash64(F.lit("second"), "host", "path").alias("u2")), "rows")
    urls = rows.groupBy("u1", "u2").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.count("*").alias("pages"))
    urls = written(judged_by_rules(written(urls, "urls"), rules), "judged")
    found = written(tokens(urls, words), "tokens")
    # Token counts are sums over pages, so a url counts as often as pages have it.
    said = urls.where("verdict is not null").select("u1", "u2", F.when(F.col("verdict") == "block", F.col("pages")).otherwise(0).alias("b"), F.when(F.col("verdict") == "block", 0).otherwise(F.col("pages")).alias("a"))
    counts = written(found.join(said, ["u1", "u2"]).groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "counts")
    n = counts.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    # Sums of decimals do not depend on the order of rows.
    weight = F.log((F.col("b") + 1) / (F.col("a") + 1)) - F.lit(math.log(n[1] + n[0]) - math.log(n[2] + n[0]) if n[0] else 0.0)
    weights = written(counts.select("token", weight.cast("decimal(20,12)").alias("w")), "weights")
    open_ = found.join(urls.where("verdict is null").select("u1", "u2"), ["u1", "u2"])
    z = open_.groupBy("u1", "u2", "token").agg(F.count("*").alias("n")).join(weights, "token").groupBy("u1", "u2").agg(F.sum((F.col("w") * F.col("n")).cast("decimal(38,12)")).cast("double").alias("z"))
    known = written(urls.join(z, ["u1", "u2"], "left").select("u1", "u2", "rule", "verdict", F.coalesce("z", F.lit(0.0)).alias("z")), "known")
    p = 1 / (1 + F.exp(-F.col("z")))
    return rows.join(known, ["u1", "u2"]).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("z") > 0, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("verdict").isNull(), p).alias("p_block"))
