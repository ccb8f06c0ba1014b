import random
import re

import pytest

from kairoframe.llm import url_filter
from kairoframe.llm.url_filter import Rule

RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("a.b", "/x", "block"), Rule("b", "/xyz", "allow"), Rule("c", "", "block")]
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def judge(spark, urls, rules=RULES, **options):
    pages = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, verdict string")
    return {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, "page_id", "url", rules, **options).collect()}


def test_against_brute_force(spark):
    r = random.Random(3)
    urls = [f"http://{'.'.join(r.choice(['a', 'b', 'c', 'net', 'Example', 'x']) for _ in range(r.randint(1, 4)))}/{r.choice(['', 'x', 'xyz', 'en/', 'en', 'xy/z?q#f'])}" for _ in range(300)]
    urls += [None, "", "nothing", "http://", "HTTP://NET", "x://y://z/", "http://net?a/b", "http://net/", "http://net/", "a\nb://net/q", "http://.net/", "http://" + "a." * 5000 + "net/" + "p" * 50_000]
    found = judge(spark, urls)
    assert found == {i: brute(u, RULES) for i, u in enumerate(urls)}


@pytest.mark.parametrize("false_positives", [None, 0.5, 0.01])
def test_exact_however_loose_the_levels_are(spark, false_positives):
    rules = [Rule(f"h{i}", "/", "block" if i % 3 else "allow") for i in range(60)]
    urls = [f"http://s.h{i}/q" for i in range(400)]
    assert judge(spark, urls, rules, false_positives=false_positives) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty_table(spark):
    assert judge(spark, []) == {}


def test_a_list_beyond_the_bound_is_looked_up_by_a_join(spark):
    r = random.Random(5)
    urls = [f"http://{r.choice(['a.b', 'b', 'x.net', 'www.example.net', 'c'])}/{r.choice(['', 'x', 'xyz', 'en/'])}" for _ in range(60)] + [None, "", "http://b/xyz", "http://b/xyz"]
    assert judge(spark, urls, most_mb=0) == judge(spark, urls) == {i: brute(u, RULES) for i, u in enumerate(urls)}


def test_the_cascade_follows_the_list_not_the_corpus(spark):
    digests = [(url_filter.digest((f"h{i}", "/")),) for i in range(20_000)]
    listed, universe = spark.createDataFrame(digests[:50], "key binary"), spark.createDataFrame(digests, "key binary")
    cascade = url_filter.build_cascade(listed, universe)
    assert sum(len(level.bits) for level in cascade.levels) * 64 <= 50 * 30
    keys = url_filter._pairs(d[0] for d in digests)
    assert cascade.has(keys).tolist() == [i < 50 for i in range(20_000)]
