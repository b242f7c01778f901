import gzip
import json
import threading

import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from faultline.llm import files, sharding, warc


def test_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x"), (2, "u\n v", "x"), (2, None, "y"), (3, "u", None), (4, "u", ""), (None, "z", "x"), (5, "u", "x")], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    root = f"file://{tmp_path}/a"
    body = warc.write_archive(df, root, file_bytes=100)
    rows = {(r.page_id, r.payload_digest): r for r in warc.read_archive(spark, root).collect()}
    digest = warc.sha1_base32(b"x")
    assert [(rows[k, digest].record_type, rows[k, digest].refers_to) for k in (1, 2, 5, None)] == [("revisit", 5), ("revisit", 5), ("response", None), ("revisit", 5)]
    assert rows[3, warc.sha1_base32(b"")].refers_to == 4 and rows[2, warc.sha1_base32(b"y")].payload == b"y" and len(rows) == 7
    with gzip.open(f"{tmp_path}/a/{body['files'][0]['path']}") as f:
        assert f.read().startswith(b"WARC/1.1\r\n")
    # The same rows make the same files, however they are dealt.
    again = warc.write_archive(df.repartition(5), f"file://{tmp_path}/b", file_bytes=100)
    read = lambda at, listed: [(x["path"].rpartition("/")[2], open(f"{tmp_path}/{at}/{x['path']}", "rb").read()) for x in listed["files"]]
    assert read("a", body) == read("b", again)
    large = warc.write_archive(df, f"file://{tmp_path}/c", least_bytes=1)
    assert warc.read_archive(spark, f"file://{tmp_path}/c").where("record_type = 'response'").count() == 4 and large["version"] == 1
    assert warc.write_archive(df.limit(0), root)["files"] == [] and files.Manifests(root).latest()[0] == 2 and warc.read_archive(spark, root).count() == 0


def heads(path, body):
    out = []
    for f in body["files"]:
        with gzip.open(f"{path}/{f['path']}") as stream:
            out += [(h, f["path"]) for h, _ in warc.records(stream)]
    return out


def test_revisits_name_their_response(spark, tmp_path):
    rows = [(7, "http://b", "x"), (7, "http://a", "x"), (3, "http://c", "x"), (3, "http://c", "x"), (None, "http://n", "x"), (9, "http://l", "y")]
    body = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    found = [h for h, _ in heads(f"{tmp_path}/w", body)]
    by_id = {h["WARC-Record-ID"]: h for h in found}
    assert len(by_id) == len(found) == 6
    revisits = [h for h in found if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 3
    for h in revisits:
        target = by_id[h["WARC-Refers-To"]]
        assert target["WARC-Type"] == "response" and target["Page-ID"] == h["Refers-To-Page-ID"] == "7" and target["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
        assert (target["WARC-Target-URI"], target["WARC-Date"]) == (h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"])


def test_shards_are_ranges_of_about_equal_bytes(spark, tmp_path):
    """Ids of all 64 bits, most rows in one narrow range, one id and the rows without an id with a third of all rows each."""
    rows = [(k, f"{k}" * 20) for k in range(1000, 1600)] + [(-(1 << 63), "low"), ((1 << 63) - 1, "high")] + [(5, f"five {k}" * 8) for k in range(600)] + [(None, f"none {k}" * 8) for k in range(600)]
    df = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string").repartition(5)
    body = warc.write_archive(df, f"file://{tmp_path}/w", shard_bytes=8_000)
    ranges, sizes = {}, {}
    for h, path in heads(f"{tmp_path}/w", body):
        shard = path.rpartition("part-")[2][:6]
        sizes[shard] = sizes.get(shard, 0) + int(h["Content-Length"])
        if h["Page-ID"] not in ("", "5"):
            ranges.setdefault(shard, []).append(int(h["Page-ID"]))
    assert len(sizes) > 10 and max(sizes.values()) < 5 * 8_000 + 900 * 100
    spans = sorted((min(x), max(x)) for x in ranges.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert sorted((r.page_id is None, r.page_id or 0, bytes(r.payload)) for r in warc.read_archive(spark, f"file://{tmp_path}/w").collect()) == sorted((i is None, i or 0, t.encode()) for i, t in rows)


def test_damage_is_seen(tmp_path):
    data = warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z").replace(b"payload", b"paylaod")
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(ValueError):
        list(warc.records(open(tmp_path / "x", "rb")))


def test_shards(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=6_000, fan_in=3, least_bytes=500)
    with pytest.raises(ValueError):
        store.read()
    rows = [(k, None if k % 7 == 0 else f"text {k * 7919 % 1000}", "x") for k in range(300)]
    for k in range(5):
        store.append(spark.createDataFrame(rows[k * 60 : (k + 1) * 60], "doc_id long, text string, path string").coalesce(2))
    before = len(store.shards())
    store.append(spark.createDataFrame([(1000, "late", 5)], "doc_id long, text string, more int"))
    old = store.read().count()
    version = store.compact()
    assert len(store.shards()) < before and version > 6 and not store.due() and store.read().count() == old == 301
    assert sorted((r.doc_id, r.text, r.path) for r in store.read().where("more is null").collect()) == rows
    reader = store.read()  # files that were merged stay until a sweep
    assert store.sweep() > 0 and store.sweep() == 0 and reader.count() == 301
    with pytest.raises(RuntimeError):
        store.manifests.commit(2, {})
    live = store.shards()
    for clash in ("doc_id string, text string", "DOC_ID long"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([], clash))
    assert store.shards() == live


def test_of_two_writers_one_commits(tmp_path):
    root = f"file://{tmp_path}/m"
    one, two = files.Manifests(root), files.Manifests(root)
    assert one.latest()[0] == two.latest()[0] == 0
    barrier, failed = threading.Barrier(8), []

    def write(k):
        barrier.wait()
        try:
            files.publish_new(f"{root}/manifests/00000001.json", json.dumps({"by": k}).encode())
        except FileExistsError:
            failed.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    version, body = one.latest()
    assert version == 1 and len(failed) == 7 and body["by"] not in failed and len(list((tmp_path / "m" / "manifests").iterdir())) == 1
    with pytest.raises(RuntimeError):
        two.commit(1, {"by": "late"})
    two.commit(2, {"by": "next"})


def test_a_hadoop_store_refuses_an_existing_file_too(spark, tmp_path, monkeypatch):
    class Remote(pafs.SubTreeFileSystem):
        pass

    monkeypatch.setattr(files, "open_store", lambda uri: (Remote("/", pafs.LocalFileSystem()), uri.removeprefix("file://").lstrip("/")))
    files.publish_new(f"file://{tmp_path}/a.json", b"1")
    with pytest.raises(FileExistsError):
        files.publish_new(f"file://{tmp_path}/a.json", b"2")
    assert (tmp_path / "a.json").read_bytes() == b"1"


def test_empty_arrivals(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fan_in=3)
    assert [store.append(none), store.append(none)] == [1, 2] and store.read().columns == ["doc_id", "text"] and store.read().count() == 0
    for _ in range(3):
        store.append(none)
    assert store.compact() > 5 and len(store.shards()) < 3 and store.read().columns == ["doc_id", "text"] and store.read().count() == 0
    store.append(none.union(spark.createDataFrame([(1, "x")], none.schema)))
    assert [tuple(r) for r in store.read().collect()] == [(1, "x")]
    none.write.parquet(f"{tmp_path}/documents.parquet")
    found = sharding.op10_sharding(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "text_sha256"] and found.count() == 0
