import datetime as dt

from assayer.llm import urlfilter

ENTRIES = [
    ("l", "Example.org", dt.datetime(2023, 1, 10), True), ("l", "example.org", dt.datetime(2023, 2, 10), False), ("l", "example.org", dt.datetime(2023, 3, 10), True),
    ("m", "a.example.org/x/y/", dt.datetime(2023, 1, 1), True), ("m", "same.day", dt.datetime(2023, 1, 1), False), ("m", "same.day", dt.datetime(2023, 1, 1), True), ("m", "off.net", dt.datetime(2023, 1, 1), None),
    ("m", None, dt.datetime(2023, 1, 1), True), (None, "x.y", dt.datetime(2023, 1, 1), True), ("m", "z.z", None, True),
]
T = lambda m, d: dt.datetime(2023, m, d)
PAGES = [
    (1, "http://example.org/", T(1, 9)), (2, "https://u:p@EXAMPLE.org.:80/x?q", T(1, 10)), (3, "http://sub.a.example.org", T(2, 10)), (4, "http://example.org", T(3, 10)), (5, "http://notexample.org", T(3, 10)),
    (6, "http://a.example.org/x/y/z", T(1, 2)), (7, "http://a.example.org/x/yy", T(1, 2)), (8, "http://same.day/", T(1, 1)), (9, "http://off.net", T(6, 1)), (10, None, T(6, 1)), (11, "not a url", T(6, 1)), (12, "http://example.org", None),
    (4, "http://example.org", T(3, 10)), (None, "http://same.day", T(1, 2)), (13, "http://" + "a." * 3000 + "example.org/" + "p/" * 3000, T(4, 1)), (14, "", T(1, 1)),
]
SCHEMA = "page_id long, url string, fetched timestamp"


def plain(url, at):
    if not url or "://" not in url or at is None:
        return []
    rest = url.split("://", 1)[1]
    host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
    path = [p.lower() for p in rest.partition("/")[2].split("?")[0].split("#")[0].split("/") if p]
    best = {}
    for name, pattern, since, listed in ENTRIES:
        if None in (name, pattern, since) or since > at:
            continue
        key = (name, pattern.lower().rstrip("/"))
        if key not in best or (since, bool(listed)) > best[key]:
            best[key] = (since, bool(listed))
    out = []
    for (name, pattern), (_, listed) in best.items():
        h, _, p = pattern.partition("/")
        parts = [x for x in p.split("/") if x]
        if listed and (host == h or host.endswith("." + h)) and path[: len(parts)] == parts:
            out.append(name)
    return sorted(out)


def check(spark):
    entries = spark.createDataFrame(ENTRIES, urlfilter.ENTRIES_SCHEMA)
    pages = spark.createDataFrame([(*r, "x", "y") for r in PAGES], SCHEMA + ", host string, pattern string")
    found = urlfilter.evaluate(pages, entries).collect()
    want = sorted((str(i), len(plain(u, t)), ",".join(sorted(set(plain(u, t)))), bool(plain(u, t))) for i, u, t in PAGES)
    assert sorted((str(r["page_id"]), r["n_matches"], r["lists"], r["blocked"]) for r in found) == want


def test_broadcast_list(spark):
    check(spark)


def test_salted_list(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "SENT", 0)
    check(spark)


def test_empty(spark):
    none = spark.createDataFrame([], urlfilter.ENTRIES_SCHEMA)
    pages = spark.createDataFrame(PAGES, SCHEMA)
    assert not any(r["blocked"] for r in urlfilter.evaluate(pages, none).collect())
    assert urlfilter.evaluate(spark.createDataFrame([], SCHEMA), spark.createDataFrame(ENTRIES, urlfilter.ENTRIES_SCHEMA)).count() == 0


def test_any_number_of_labels(spark, monkeypatch):
    long = ".".join("abcdefghij") + ".example.org"
    entries = [("l", long, T(1, 1), True), ("m", "d." + long.split(".d.")[1] + "/x", T(1, 1), True), ("n", "net", T(1, 1), True), ("n", "net", T(5, 1), False)]
    pages = [(1, f"http://{long}/", T(2, 1)), (2, f"http://www.{long}/x/y", T(2, 1)), (3, f"http://z{long}/x", T(2, 1)), (4, "http://example.org/x", T(2, 1)), (5, "http://a.b.net", T(2, 1)), (6, "http://net/", T(2, 1)), (7, "http://a.net", T(6, 1)), (8, "http://a.b", T(2, 1))]
    monkeypatch.setattr(f"{__name__}.ENTRIES", entries)
    monkeypatch.setattr(f"{__name__}.PAGES", pages)
    assert [plain(u, t) for _, u, t in pages] == [["l"], ["l", "m"], ["m"], [], ["n"], ["n"], [], []]
    check(spark)
    monkeypatch.setattr(urlfilter, "SENT", 0)
    check(spark)


def test_addresses_and_time_zones(spark, monkeypatch):
    entries = spark.createDataFrame([("l", "10.0.0.1", T(1, 1), True), ("m", "0.1", T(1, 1), True), ("n", "10.0.0.1/x", T(1, 1), True)], urlfilter.ENTRIES_SCHEMA)
    pages = spark.createDataFrame([(1, "http://10.0.0.1/", T(2, 1)), (2, "http://10.0.0.1:80/x/y", T(2, 1)), (3, "http://1.10.0.0.1/", T(2, 1)), (4, "http://0.1/", T(2, 1)), (5, "http://9.0.0.1/", T(2, 1))], SCHEMA)
    assert {r["page_id"]: r["lists"] for r in urlfilter.evaluate(pages, entries).collect()} == {1: "l", 2: "l,n", 3: "m", 4: "m", 5: ""}
    table = spark.createDataFrame([(i, f"http://spam-farm.example.{'com' if i % 2 else 'org'}/") for i in range(400)], "page_id long, url string")
    zone, found = spark.conf.get("spark.sql.session.timeZone"), []
    for other in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", other)
        found.append(sorted(map(str, urlfilter.digest(urlfilter.evaluate(urlfilter.with_times(table), urlfilter.query_entries(spark))).collect())))
    spark.conf.set("spark.sql.session.timeZone", zone)
    assert found[0] == found[1]
