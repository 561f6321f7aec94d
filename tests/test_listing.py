"""Object listings: the whole, and what is new over restarts."""

import os

from talespark.sources.listing import newest_objects, read_listing, stream_listing


def put(root, key, seconds, content="x"):
    at = root / key
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(content)
    os.utime(at, (seconds, seconds))


def test_whole_listing(spark, tmp_path):
    root = tmp_path / "store"
    assert read_listing(spark, str(root)).count() == 0
    for k, key in enumerate(["p/1/a.json", "p/1/b.txt", "p/ü c.json"]):
        put(root, key, 1000 + k, "x" * k)
    rows = {r.key: (int(r.last_modified.timestamp()), r.size) for r in read_listing(spark, str(root), ".json").collect()}
    assert rows == {"p/1/a.json": (1000, 0), "p/ü c.json": (1002, 2)}
    assert [r.key for r in newest_objects(read_listing(spark, str(root)), 2).collect()] == ["p/ü c.json", "p/1/b.txt"]


def test_new_objects_are_listed_once_over_restarts(spark, tmp_path):
    root, seen = tmp_path / "store", []

    def run(wanted):
        def take(batch, n):
            seen.append([r.key for r in batch.collect()])

        q = stream_listing(spark, str(root), ".json", page=3).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
        q.processAllAvailable()
        q.stop()
        assert sum(map(len, seen)) == wanted

    for k in range(7):
        put(root, f"p/{k % 2}/{k}.json", 2000 + k // 3)  # ties in time
    put(root, "p/no.txt", 2500)
    run(7)
    assert max(map(len, seen)) <= 3 and [k for page in seen for k in page] == ["p/0/0.json", "p/0/2.json", "p/1/1.json", "p/0/4.json", "p/1/3.json", "p/1/5.json", "p/0/6.json"]
    put(root, "p/0/7.json", 2002)  # the time of the last one, a later key
    put(root, "p/0/0.json", 3000)  # rewritten
    run(9)
    assert [k for page in seen for k in page][7:] == ["p/0/7.json", "p/0/0.json"]
    run(9)
