"""The URL filter on deep paths against its SQL, against a tree built in Python, and on planted bad sections."""

import collections
import math
import random

import duckdb

from frameloom.llm import sql, url_filter


def paths(rng, depth):
    return "/" + "/".join(rng.choice(("a", "b", "en", "de", "es", "fr", "item7", "x-1")) for _ in range(rng.randint(0, depth)))


def deep_urls(n=700):
    rng = random.Random(21)
    hosts = ("one.com", "two.com", "www.example.org", "net.net", "EXAMPLE.org", "slug.com")
    urls = [f"http://{rng.choice(hosts)}{paths(rng, 7)}" for _ in range(n)]
    urls += [f"http://slug.com/de/part/{rng.getrandbits(40):x}/end" for _ in range(60)] + [f"http://one.com/deep/{'s/' * 300}{k}" for k in ("a", "b")]
    return urls + [None, "", "no url", "http://one.com", "http://one.com/", "http://one.com//a//b/"]


def test_paths_of_any_depth_equal_the_sql(spark):
    rows = list(enumerate(deep_urls()))
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    out = url_filter.judge(pages)
    plain = lambda rs: sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rs)
    assert plain(out.collect()) == plain(con.execute(f"SELECT {', '.join(out.columns)} FROM ({sql.OP8})").fetchall())


def template(rows, many=8, share=0.2, z=2.0):
    """{key: template} of one host's rows {key: (n, lab, bad)}, node by node."""
    out = {}

    def go(keys, d, done):
        live = collections.defaultdict(list)
        for k in keys:
            segs = [s for s in k.split("/") if s]
            if len(segs) <= d:
                out[k] = done
            else:
                live[segs[d]].append(k)
        below = [k for ks in live.values() for k in ks]
        if len(below) == 1:
            out[below[0]] = done + "/" + "/".join([s for s in below[0].split("/") if s][d:])
            return
        total = [sum(rows[k][i] for k in below) for i in range(3)]
        to = collections.defaultdict(list)
        for seg, ks in live.items():
            lab, bad = (sum(rows[k][i] for k in ks) for i in (1, 2))
            rest, rest_bad = total[1] - lab, total[2] - bad
            if lab and rest:
                p = total[2] / total[1]
                error = math.sqrt(p * (1 - p) * (1 / lab + 1 / rest))
                alike = error == 0 or abs(bad / lab - rest_bad / rest) < z * error
            else:
                alike = total[1] == 0
            merge = (len(live) >= many and len(live) >= share * total[0]) or (len(live) > 1 and alike)
            to["*" if merge else seg] += ks
        for seg, ks in to.items():
            go(ks, d + 1, f"{done}/{seg}")

    go(list(rows), 0, "")
    return out


def test_templates_equal_a_tree_in_python(spark):
    rng = random.Random(22)
    rows = {}
    for _ in range(300):
        key = paths(rng, 5).replace("7", "#").replace("1", "#")
        lab = rng.choice((0, 0, 1, 5, 30))
        rows[key] = (lab + rng.randint(1, 3), lab, sum(rng.random() < (0.9 if "de" in key else 0.1) for _ in range(lab)))
    counts = spark.createDataFrame([("h", k, [s for s in k.split("/") if s], *v) for k, v in rows.items()], "host string, key string, segs array<string>, n long, lab long, bad long")
    assert {r.key: r.template for r in url_filter.templates(counts, 8, 0.2, 2.0).collect()} == template(rows)


def test_planted_sections_and_hosts_without_labels(spark):
    rng = random.Random(23)
    rows, want = [], {}

    def page(url, bad, label):
        want[len(rows)] = "block" if bad else "allow"
        rows.append((len(rows), url, label))

    for _ in range(400):
        word = "".join(rng.choice("abcdefghij") for _ in range(9))
        page(f"http://shop.net/pills/{word}/buy", True, True if rng.random() < 0.3 else None)
        page(f"http://shop.net/books/{word}/buy", False, False if rng.random() < 0.3 else None)
        page(f"http://other.net/pills/{word}/buy", False, None)
        page(f"http://mixed.net/{rng.choice(('p', 'q'))}/{word}", False, rng.random() < 0.2 if rng.random() < 0.3 else None)
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, label_col="bad").collect()}
    hits = sum(got[i] == "block" == v for i, v in want.items())
    assert hits >= 0.9 * sum(v == "block" for v in want.values()) and hits >= 0.9 * sum(v == "block" for v in got.values())
    ruled = [(i, f"http://example.org/es/{i}") for i in range(9)] + [(100 + i, f"http://{h}.net/es/{i}") for i in range(10) for h in "xyz"]
    got = url_filter.judge(spark.createDataFrame(ruled, "page_id long, url string")).collect()
    assert all((r.verdict == "block") == (r.page_id < 100) for r in got)
