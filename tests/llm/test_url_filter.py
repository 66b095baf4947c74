import random
from datetime import datetime, timedelta
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from quire.llm import url_filter as uf

DAY = datetime(2024, 1, 1)


def plain(url, t, entries):
    if url is None or t is None or "://" not in url:
        return set(), 0
    parts = urlsplit(url)
    host = (parts.hostname or "").rstrip(".")
    if not host:
        return set(), 0
    path = [x for x in parts.path.split("/") if x]
    last = {}
    for x, kind, pattern, action, since in entries:
        if None in (x, pattern, since) or action not in ("add", "remove") or since > t:
            continue
        if kind == "prefix":
            head, _, rest = pattern.partition("/")
            name = (head.lower(), *[p for p in rest.split("/") if p])
            ok = name[0] == host and list(name[1:]) == path[: len(name) - 1]
        else:
            name = (pattern.strip().lower().strip("."),)
            ok = host == name[0] or (kind == "domain" and host.endswith("." + name[0]))
        if ok and kind in ("domain", "host", "prefix"):
            key = (x, kind, name)
            last[key] = max(last.get(key, (since, "")), (since, action))
    active = [k for k, (_, a) in last.items() if a == "add"]
    return {k[0] for k in active}, len(active)


def test_against_the_plain_rule(spark):
    rng = random.Random(4)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "ba.com"]
    entries = [(rng.choice(["l1", "l2"]), rng.choice(["domain", "host", "prefix", "other"]), rng.choice(hosts) + rng.choice(["", "", "/p", "/p/q/"]), rng.choice(["add", "add", "remove", "x"]), DAY + timedelta(days=rng.randint(0, 9))) for _ in range(60)]
    entries = [e if e[1] in ("prefix", "other") else (*e[:2], e[2].split("/")[0], *e[3:]) for e in entries]
    entries += [(None, "host", "a.com", "add", DAY), ("l1", "host", None, "add", DAY), ("l1", "host", "b.org", "add", None), ("l3", "domain", ".COM", "add", DAY)] + entries[:3]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u:p@'])}{rng.choice(hosts)}{rng.choice(['', '.', ':80'])}{rng.choice(['', '/', '/p', '/p/q', '/pq?x=/p', '/p#a'])}" for _ in range(80)]
    urls += [None, "", "no url", "http://", "http:///p", "ftp://A.COM/p"]
    rows = [(i, u, rng.choice([None, DAY - timedelta(1), *[DAY + timedelta(days=k, hours=rng.randint(0, 1)) for k in range(11)]]), "old") for i, u in enumerate(urls * 4)]
    rows += rows[:5]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp, lists string").withColumn("u", F.lit(1)).withColumn("t", F.lit(1)).withColumn("key", F.lit("k"))
    log = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, since timestamp")
    got = sorted((r.page_id, tuple(r.lists), r.n_active, r.blocked) for r in uf.url_filter(captures, log).collect())
    want = sorted((i, tuple(sorted(plain(u, t, entries)[0])), plain(u, t, entries)[1], plain(u, t, entries)[1] > 0) for i, u, t, _ in rows)
    assert got == want
    assert not any(r.blocked for r in uf.url_filter(captures, log.limit(0)).collect())
    assert uf.url_filter(captures.limit(0), log).count() == 0
