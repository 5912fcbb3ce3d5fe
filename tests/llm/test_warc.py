import gzip
import hashlib
import json
from pathlib import Path

import pytest

from kinfold.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, last long, shard int"


def pages(spark, extra=()):
    big, other = "<p>" + "x" * 1500, "<p>" + "é" * 800
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "http://b/\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (8, "u", other), (8, "u", other), (None, "n", other), (None, "n", "tiny"), (10, "u", "y" * 2_000_000), (-(1 << 62) - 1, "u", "far"), ((1 << 62) + 1, "u", "far"), *extra]
    return spark.createDataFrame([(*r, "d", 5, 6) for r in rows], SCHEMA)


def expected(rows):
    best = {}
    for r in rows:
        p = (r.html or "").encode()
        if len(p) >= 1000 and r.page_id is not None:
            best[p] = max(best.get(p, r.page_id), r.page_id)
    out = []
    for r in rows:
        p = (r.html or "").encode()
        to = best.get(p)
        revisit = to is not None and r.page_id != to
        out.append((r.page_id, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark, tmp_path):
    p = pages(spark)
    out = f"file://{tmp_path}/w"
    pointer = warc.write_archives(p, out)
    assert result(warc.read_archives(spark, out)) == expected(p.collect())
    assert pointer["n_records"] == p.count()
    assert not (tmp_path / "w/_temporary").exists()
    assert json.loads((tmp_path / "w/manifest.json").read_text()) == pointer


def listed(spark, out):
    pointer, files = warc.manifest(spark, out)
    return pointer["run"], [r.asDict() for r in files.orderBy("shard", "part").collect()]


def test_a_second_run_replaces_the_first_and_leaves_other_writers_alone(spark, tmp_path):
    out, p = f"file://{tmp_path}/w", pages(spark)
    other = tmp_path / "w/_temporary/someone-else"
    other.mkdir(parents=True)
    first = warc.write_archives(p, out)
    assert warc.write_archives(p.repartition(3), out) == first
    assert result(warc.read_archives(spark, out)) == expected(p.collect())
    more = pages(spark, [(77, "u", "new")])
    second = warc.write_archives(more, out)
    assert second["run"] != first["run"] and not (tmp_path / "w" / first["run"]).exists() and other.exists()
    assert result(warc.read_archives(spark, out)) == expected(more.collect())


def test_a_crash_between_moves_or_before_the_pointer_is_mended(spark, tmp_path, monkeypatch):
    out, p = f"file://{tmp_path}/w", pages(spark, [(i, f"u{i}", f"page {i} " * (i % 50 + 1)) for i in range(100, 300)])
    old = warc.write_archives(pages(spark), out)
    real = warc._mover

    def crashing(base, run):
        move = real(base, run)

        def some(batches):
            for b in batches:
                yield from move(iter([b.slice(0, 1)]))
                if b.num_rows > 1 or b.column("name")[0].as_py().endswith("00001.warc.gz"):
                    raise RuntimeError("lost")

        return some

    monkeypatch.setattr(warc, "_mover", crashing)
    with pytest.raises(Exception, match="lost"):
        warc.write_archives(p, out, roll_bytes=4000)
    assert result(warc.read_archives(spark, out)) == expected(pages(spark).collect())
    assert any(f.suffix == ".gz" for d in (tmp_path / "w").glob("run-*") if d.name != old["run"] for f in d.iterdir())
    monkeypatch.setattr(warc, "_mover", real)
    warc.write_archives(p, out, roll_bytes=4000)
    assert result(warc.read_archives(spark, out)) == expected(p.collect())


def test_reading_before_a_commit_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        warc.read_archives(spark, f"file://{tmp_path}/none")


def test_same_rows_same_bytes_and_rolled_sorted_files(spark, tmp_path):
    p = pages(spark, [(i, f"u{i}", f"page {i} " * (i % 50 + 1)) for i in range(100, 400)])
    digests = []
    for n, parts in (("a", 1), ("b", 6)):
        out = f"file://{tmp_path}/{n}"
        warc.write_archives(p.repartition(parts), out, roll_bytes=8000, shard_bytes=100_000)
        run, files = listed(spark, out)
        digests.append([(f["name"], f["sha256"], f["n_bytes"]) for f in files])
        for f in files:
            data = (tmp_path / n / run / f["name"]).read_bytes()
            assert len(data) == f["n_bytes"] and hashlib.sha256(data).hexdigest() == f["sha256"]
        assert result(warc.read_archives(spark, out)) == expected(p.collect())
        back = warc.read_archives(spark, out).collect()
        assert len(files) > 5 and len({f["shard"] for f in files}) > 1 and len(back) == p.count()
        order = [[r.page_id for r in back if r.file == f["name"]] for f in files]
        flat = [(i is not None, i or 0) for part in order for i in part]
        assert flat == sorted(flat)
    assert digests[0] == digests[1]


def test_files_are_plain_warc(spark, tmp_path):
    warc.write_archives(pages(spark), f"file://{tmp_path}/w")
    with gzip.open(next(Path(tmp_path / "w").glob("run-*/*.warc.gz"))) as f:
        records = list(warc.parse(f))
    assert records[0][0]["WARC-Type"] == "warcinfo"
    for head, block in records:
        assert len(block) == int(head["Content-Length"])
    heads = [h for h, _ in records[1:]]
    assert all(h["WARC-Profile"] == warc.PROFILE for h in heads if h["WARC-Type"] == "revisit")
    assert any(h["WARC-Target-URI"] == "http://b/%0D%0AX: y" for h in heads)


def test_damage_is_noticed(tmp_path):
    good = warc.record(1, "u", b"payload" * 10, None, 0)
    import io

    assert len(list(warc.parse(io.BytesIO(good)))) == 1
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(good.replace(b"payload", b"pAyload", 1))))


def test_empty_table(spark, tmp_path):
    out = f"file://{tmp_path}/w"
    assert warc.write_archives(spark.createDataFrame([], SCHEMA), out)["n_files"] == 0
    assert warc.read_archives(spark, out).count() == 0
