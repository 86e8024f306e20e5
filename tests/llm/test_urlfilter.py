import collections
import math
import re
import zlib

from weftline.llm import queries, urlfilter

PAGES = "page_id long, url string, html string, host string, verdict string"


def plain(url, rules=queries.RULES):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:end].translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    tail = rest[end:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for said, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (said, rule)
    return host, path, best and best[1], best and best[0]


URLS = [
    "http://Ab.Example.COM/en/x?y=1#z", "https://www.example.com/en/", "http://www.example.com/en", "http://example.com", "http://com/", "http://a.b.net/es/1", "http://net/fr/", "http://xnet/fr/", "net/es/", "",
    None, "ftp://h.org?q=/p", "http://h.org#a/b", "x://y://z/p", "http:///path", "http://Ä.com/en/", "http://a.com/" + "p" * 100_000, "://www.x.example.com/en/ä", "http://h.org/a\nb?c",
]


def test_rules_and_parts(spark):
    rows = [(i, u, "<p>words of a page</p>", "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[0], None, "x", "y"), (1, URLS[1], "", "x", "y")]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, PAGES).repartition(2), queries.RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            host, path, rule, verdict = plain(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == verdict if verdict else r.verdict in ("allow", "block") and 0 <= r.p_block <= 1
    assert urlfilter.filter_urls(spark.createDataFrame([], PAGES), queries.RULES).collect() == []


def test_viterbi_finds_the_best_split():
    counts = {"cheap": 50, "pills": 40, "che": 3, "ap": 2, "pill": 5, "s": 9}
    seg = urlfilter.Segmenter(counts, sum(counts.values()))
    assert seg.split("cheappills") == ["cheap", "pills"]

    def best(name):
        if not name:
            return 0.0
        return min(seg.cost.get(name[:i], seg.unknown(i)) + best(name[i:]) for i in range(1, min(len(name), urlfilter.LONGEST) + 1))

    for name in ("cheapzz", "zpillsap", "chepill", "q"):
        assert abs(sum(seg.cost.get(w, seg.unknown(len(w))) for w in seg.split(name)) - best(name)) < 1e-9


def test_learned_verdicts(spark):
    html = "<p>good news bad pills</p>" * 5
    rows = [(i, f"http://{'badpills' if i % 2 else 'goodnews'}{i}.com/{'block' if i % 2 else 'allow'}/", html, "", "") for i in range(40)]
    rows += [(100, "http://badpills.org/", html, "", ""), (101, "http://goodnews.org/", html, "", ""), (102, "http://zzz.org/", html, "", "")]
    rules = [("allow", "com/allow/"), ("block", "com/block/")]
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(spark.createDataFrame(rows, PAGES), rules).collect()}
    assert (got[100], got[101], got[102]) == ("block", "allow", "allow")


def test_query_on_whole_table(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op3_url_filter(spark, sf).collect()
    assert {r.page_id for r in got} == set(urls)
    for r in got:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or verdict == r.verdict)


def plain_verdicts(pages, rules):
    """page_id -> (verdict, probability to block) by loops and dictionaries."""
    words = collections.Counter(w for _, _, h in pages for w in urlfilter.LETTERS.findall(urlfilter.MARKUP.sub(" ", h or "").lower()))
    total = sum(words.values())
    seg = urlfilter.Segmenter(words, total)

    def split(name):
        """All words and all runs of no word, by every end."""
        best = [(0.0, 0)]
        for j in range(1, len(name) + 1):
            best.append(min((best[i][0] + (seg.cost[name[i:j]] if name[i:j] in words else seg.unknown(j - i)), i) for i in range(j)))
        out, j = [], len(name)
        while j:
            out.append(name[best[j][1]:j])
            j = best[j][1]
        return out[::-1]

    def tokens(host, path):
        for kind, text in (("h:", host), ("p:", path.lower())):
            for part in re.findall(r"[a-z]+|[0-9]+|[^\W_a-z0-9]+", text):
                for w in split(part) if part[0] in urlfilter.LOWER else [f"#{len(part)}" if part.isdigit() else part]:
                    yield kind + w

    said, count = {}, {"block": collections.Counter(), "allow": collections.Counter()}
    for i, url, _ in pages:
        host, path, rule, verdict = plain(url, rules)
        said[i] = (verdict, list(tokens(host, path)))
        if verdict:
            count[verdict].update(said[i][1])
    known = set(count["block"]) | set(count["allow"])
    out = {}
    for i, (verdict, found) in said.items():
        z = sum(math.log((count["block"][t] + 1) / (count["block"].total() + len(known))) - math.log((count["allow"][t] + 1) / (count["allow"].total() + len(known))) for t in found if t in known)
        out[i] = (verdict, None) if verdict else ("block" if z > 1e-9 else "allow", 1 / (1 + math.exp(-z)))
    return out


def test_verdicts_against_a_plain_version(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    want = plain_verdicts([tuple(r) for r in df.collect()], queries.RULES)
    got = {r.page_id: (r.verdict, r.p_block) for r in queries.op3_url_filter(spark, sf).collect()}
    assert set(got) == set(want)
    for i, (said, p) in want.items():
        assert got[i][0] == said and (p is None) == (got[i][1] is None) and (p is None or abs(p - got[i][1]) < 1e-6)


def test_words_of_any_number_and_length(spark):
    """60,000 words commoner than the one that matters, and words of 40 letters."""
    rare, long = "seldomword", "qwertyuiopasdfghjklzxcvbnmqwertyuiopasdf"
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) + "x" for i in range(60_000)]
    rows = [(i, None, " ".join(names[i * 600:(i + 1) * 600] * 2) + (f" {rare} {long}" if i == 0 else "")) for i in range(100)]
    rows += [(1000, f"http://{rare}{long}.com/block/", None), (1001, f"http://{names[5]}.com/allow/", None), (1002, f"http://{long}{rare}.org/", None), (1003, f"http://{names[5]}.org/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    counts = urlfilter.word_counts(df, "html")
    assert counts.count() == 60_002
    parts = {r["name"]: r["parts"] for r in urlfilter.segmented(spark.createDataFrame([(rare + long,), (long + names[7],), ("",), ("7",)], "name string"), counts).collect()}
    assert parts == {rare + long: [rare, long], long + names[7]: [long, names[7]], "": [], "7": ["7"]}
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(df, [("block", "com/block/"), ("allow", "com/allow/")]).collect()}
    assert (got[1000], got[1001], got[1002], got[1003]) == ("block", "allow", "block", "allow")


def test_a_thousand_and_more_rules(spark):
    rules = [("block" if i % 2 else "allow", f"host{i}.net/a/") for i in range(1200)] + [("allow", f"one.org/p{i}/") for i in range(1200)] + [("block", "net/"), ("block", "org/p7")]
    rows = [(i, f"http://w.host{i}.net/{'a/' if i % 3 else ''}", None) for i in range(0, 1200, 7)] + [(5000 + i, f"http://one.org/p{i}/x", None) for i in range(0, 1400, 9)]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    for i, url, _ in rows:
        _, _, rule, verdict = plain(url, rules)
        assert got[i][0] == rule and (verdict is None or got[i][1] == verdict), url


def test_repeated_pages_and_null_html(spark):
    rows = [(i % 3, "http://badpills.com/block/", None) for i in range(500)] + [(None, "http://badpills.org/", None)] * 20 + [(9, "http://" + "unknownletters" * 5 + ".net/", None), (8, "http://good.com/allow/", None)]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), [("block", "com/block/"), ("allow", "com/allow/")]).collect()
    assert len(got) == len(rows) and {(r.page_id, r.verdict) for r in got} == {(0, "block"), (1, "block"), (2, "block"), (None, "block"), (9, "allow"), (8, "allow")}
    none = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), []).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")}


def test_held_out_pages(spark):
    """Pages that a rule decides, judged without it: by the hosts' registered part, one in four held out."""
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html").collect()]
    rules = [("allow", "com/"), ("block", "com/en/")]
    truth = {i: plain(u, rules)[3] for i, u, _ in pages if plain(u, rules)[3]}
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 0}
    hidden = [(i, u.replace(".com", ".xyz", 1) if i in held else u, h) for i, u, h in pages]
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(spark.createDataFrame(hidden, "page_id long, url string, html string"), rules).collect()}
    right = sum(got[i] == truth[i] for i in held)
    print("held out", right, len(held))
    assert len(held) > 20 and right >= 0.9 * len(held)
