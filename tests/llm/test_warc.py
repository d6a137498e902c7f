import gzip
import hashlib
import random
from pathlib import Path

import pytest

from chatterlake.llm import warc
from chatterlake.llm.storage import new_folder

SCHEMA = "page_id long, url string, html string, key long, digest string, salt int"


def made():
    rng = random.Random(5)
    big = ["é世" * 400 + str(i) for i in range(4)]
    html = [rng.choice([*big, "x" * 999, "x" * 1000, "", None, "a\r\n\r\nb" * 300]) for _ in range(120)]
    rows = [(i * 7 - 30, f"http://a/ü b?{i}\n", h, 1, "d", 2) for i, h in enumerate(html)]
    return rows + [(None, None, big[0], 1, "d", 2), (None, "u", "lone" * 500, 1, "d", 2), (5000, "u", "Z" * 3000, 1, "d", 2)]


def want(rows):
    best = {}
    for k, _, h, *_ in rows:
        if k is not None:
            best[h or ""] = max(best.get(h or "", k), k)
    counts = {}
    for r in rows:
        counts[r[2] or ""] = counts.get(r[2] or "", 0) + 1
    out = []
    for k, u, h, *_ in rows:
        raw = (h or "").encode()
        top = best.get(h or "")
        again = len(raw) >= 1000 and counts[h or ""] > 1 and top is not None and k != top
        out.append((k, u, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None, None if again else raw))
    return sorted(map(repr, out))


@pytest.mark.parametrize("most", [200_000, 0])
def test_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    monkeypatch.setattr(warc, "RANGE_BYTES", 3000)
    rows = made()
    folder = new_folder(spark, "test-warc")
    index = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), folder)
    got = warc.read_archives(index).collect()
    line = lambda r: (r.key, r.url, r.payload_bytes, r.digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
    assert sorted(repr(line(r)) for r in got) == want(rows)
    some = warc.read_archives(index.where("key % 5 = 0")).collect()
    assert sorted(r.key for r in some) == sorted(r[0] for r in rows if r[0] is not None and r[0] % 5 == 0)
    files = sorted(Path(folder.removeprefix("file:")).glob("*.warc.gz"))
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == len(rows)


def test_no_rows(spark):
    index = warc.write_archives(spark.createDataFrame([], SCHEMA), new_folder(spark, "test-warc"))
    assert index.collect() == [] and warc.read_archives(index).collect() == []


def test_damage_is_an_error():
    raw = warc.record_bytes(1, "u", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None, False)
    assert warc.parse_record(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"abc", b"abd"))
