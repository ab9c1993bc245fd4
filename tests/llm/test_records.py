"""WARC archives and preference formatting."""

import gzip
import hashlib

import pytest

from peerspark.llm import warc
from peerspark.llm.preference import preference_segments, preference_texts, swapped_replies

PAGES = [(1, "http://a/1", "x" * 150), (2, "http://a/2", "x" * 150), (3, None, "short"), (4, "http://a/4\r\nX: y", "short"), (5, "http://é/", None),
         (6, "http://a/6", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (8, "u", "é" * 50), (None, "n", "x" * 150), (9, "http://a/9", "\r\n\r\nWARC/1.1\r\n" * 20)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_archive_and_read_back(spark, tmp_path):
    rows = warc.archive_pages(pages(spark), str(tmp_path / "w")).collect()
    assert len(rows) == len(PAGES)
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", bytes(r["payload"]).decode() if r["payload"] is not None else "-", r["payload_digest"], r["payload_length"]) for r in rows)
    want = []
    for i, _, html in PAGES:
        text = html or ""
        again = len(text.encode()) >= 100 and first[text] != i
        want.append((f"<urn:page:{'' if i is None else i}>", "revisit" if again else "response", f"<urn:page:{first[text]}>" if again else "",
                     "-" if again else text, "sha256:" + hashlib.sha256(text.encode()).hexdigest(), len(text.encode())))
    assert got == sorted(want)


def test_predicates_are_pushed_and_skip_payloads(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.archive_pages(pages(spark), path)
    load = lambda: spark.read.format("warc").load(path)
    revisits = load().filter("record_type = 'revisit' and target_uri like 'http%'")
    assert "Filter" not in revisits._jdf.queryExecution().executedPlan().toString().replace("PushedFilters", "").split("BatchScan")[0]
    assert revisits.count() == 1
    rows = load().drop("headers").collect()
    plain = spark.createDataFrame(rows, load().drop("headers").schema)
    for condition in ("record_type in ('response') and payload_length >= 100", "refers_to is null and not record_type = 'revisit'", "refers_to <=> null",
                      "target_uri <> 'u'", "payload_digest = 'none'", "payload_length < 10 or record_type = 'revisit'", "not target_uri in ('u', 'n')"):
        assert sorted(r["record_id"] for r in load().filter(condition).collect()) == sorted(r["record_id"] for r in plain.filter(condition).collect())
    assert load().filter("headers['WARC-Type'] = 'revisit'").count() == 4
    assert spark.read.format("warc").option("payload", "false").load(path).filter("payload is not null").count() == 0


def test_unwanted_payloads_are_not_inflated(spark, tmp_path):
    big = warc._record({"record_id": "<a>", "record_type": "response", "payload": bytes(range(256)) * 40_000})
    small = warc._record({"record_id": "<b>", "record_type": "revisit", "refers_to": "<a>", "payload_length": 5})
    (tmp_path / "a.warc.gz").write_bytes(warc._member(big) + warc._member(small))
    reader = warc.WarcReader(str(tmp_path), 1 << 20, True)
    seen = []
    original = warc._inflate
    warc._inflate = lambda window, at, limit, end=b"": seen.append(len((out := original(window, at, limit, end))[0])) or out
    try:
        tests = [lambda row: row["record_type"] == "revisit"]
        with open(tmp_path / "a.warc.gz", "rb") as f:
            got = list(reader._records(warc._Window(f), (tmp_path / "a.warc.gz").stat().st_size, tests))
    finally:
        warc._inflate = original
    assert [r["record_id"] for r in got] == ["<b>"] and max(seen) < len(big) / 4


def test_foreign_archives_and_partitions(spark, tmp_path):
    rec = lambda i, kind, body: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\nX-Long: a\r\n b\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    parts = [rec(1, "warcinfo", b""), rec(2, "resource", b"abc" * 30_000), rec(3, "resource", b"WARC/1.0\r\n\r\n")]
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "zipped.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    warc.register(spark)
    df = spark.read.format("warc").option("partition_bytes", "100").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 2
    rows = df.filter("record_type = 'resource'").collect()
    assert sorted((r["record_id"], len(r["payload"])) for r in rows) == [("<2>", 90_000), ("<2>", 90_000), ("<3>", 12), ("<3>", 12)]
    assert rows[0]["headers"]["X-Long"] == "a b"
    one = spark.read.format("warc").load(str(tmp_path / "plain.warc"))
    assert one.count() == 3


def test_one_gzip_member_with_several_records(spark, tmp_path):
    """All records of a member are read, whatever the case of header names."""
    record = lambda i, kind: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\ncontent-type: application/http\r\n"  # noqa: E731
                              f"Content-Length: {len(f'HTTP/1.1 200 OK' + chr(13) + chr(10)) + 2 + 5 + len(str(i))}\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody {i}\r\n\r\n").encode()
    data = b"".join(record(i, "response" if i % 2 else "resource") for i in range(5))
    (tmp_path / "many.warc.gz").write_bytes(gzip.compress(data) + gzip.compress(record(5, "response")))
    warc.register(spark)
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    assert {r["record_id"]: bytes(r["payload"]) for r in rows} == {f"<urn:x:{i}>": f"body {i}".encode() for i in range(6)}
    only = spark.read.format("warc").load(str(tmp_path)).filter("record_type = 'resource'").collect()
    assert sorted(r["record_id"] for r in only) == ["<urn:x:0>", "<urn:x:2>", "<urn:x:4>"]


def test_empty_table_and_second_write(spark, tmp_path):
    path = str(tmp_path / "w")
    assert warc.archive_pages(pages(spark, []).limit(0), path).count() == 0
    with pytest.raises(Exception, match="FileExistsError|already|exists"):
        warc.archive_pages(pages(spark), path)


TURNS = "pair_id long, turn long, role string, text string, part string"


def plain(chosen, rejected):
    """Prompt, completions and masks of one pair, turn by turn."""
    key = lambda r: (r[1] if r[1] is not None else 1 << 63, r[2] or "", r[3] or "")
    c, r = sorted(map(key, chosen)), sorted(map(key, rejected))
    cut = min((t for t, _, _ in [*c, *r] if [x for x in c if x[0] == t] != [x for x in r if x[0] == t]), default=None)
    show = lambda x: f"<|im_start|>{x[1]}\n{x[2]}<|im_end|>\n"
    prompt = "".join(show(x) for x in c if cut is None or x[0] < cut)
    out = [prompt]
    for side in (c, r):
        text, mask = "", []
        for x in side:
            if cut is not None and x[0] >= cut:
                start = len(prompt) + len(text)
                text += show(x)
                if x[1] == "assistant":
                    mask.append((start + len(f"<|im_start|>{x[1]}\n"), len(prompt) + len(text)))
        out += [text, mask]
    return tuple(out)


def test_preference_pairs(spark):
    base = [(0, "system", "s"), (1, "user", "hi"), (2, "assistant", "yes"), (3, "user", "more"), (4, "assistant", "sure")]
    sides = {
        1: (base, [*base[:4], (4, "assistant", "no")]), 2: (base, base), 3: (base, base[:2]), 4: (base, []), 5: ([], base),
        6: (base, [(0, "system", "other"), *base[1:]]), 7: ([*base, (None, None, None)], base), 8: ([*base, base[2], base[2]], [*base, base[2]]),
        9: ([(k, "user" if k % 2 else "assistant", f"t{k}") for k in range(1200)], [(k, "user" if k % 2 else "assistant", f"t{k}" if k < 900 else "z") for k in range(1200)]),
        10: ([(0, "assistant", ""), (0, None, None)], [(0, None, None), (0, "assistant", None)])}
    rows = [[(p, *t, "clash") for p, s in sides.items() for t in s[k]] for k in (0, 1)]
    rows[0].append((None, 0, "user", "lost", "clash"))
    segments = preference_segments(*[spark.createDataFrame(r, TURNS).repartition(5) for r in rows])
    got = {r["pair_id"]: (r["prompt"], r["chosen"], [tuple(m) for m in r["chosen_mask"]], r["rejected"], [tuple(m) for m in r["rejected_mask"]])
           for r in preference_texts(segments).collect()}
    want = {p: plain([(p, *t) for t in c], [(p, *t) for t in r]) for p, (c, r) in sides.items()}
    assert got == want
    empty = spark.createDataFrame([], TURNS)
    assert preference_segments(empty, empty).count() == 0


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"), (1, 0, "user", "d"), (1, 1, "assistant", "e"), (2, 0, "user", "f"),
            (3, 0, "assistant", None), (4, 1, "assistant", "lone"), (None, 1, "assistant", "x")]
    chosen, rejected = swapped_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chosen.count() == 8
    assert sorted(tuple(r) for r in rejected.collect()) == [
        (0, 0, "user", "a"), (0, 1, "assistant", "e"), (1, 0, "user", "d"), (1, 1, "assistant", "b"), (2, 0, "user", "f")]


def test_native_plan(spark):
    df = preference_segments(*swapped_replies(spark.createDataFrame([(0, 0, "user", "a")], "conv_id long, turn long, role string, text string")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
