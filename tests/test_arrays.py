"""JSON arrays that several tasks read."""

import json
import random

import pyarrow as pa
import pytest

from feedloom.schema import ARTICLE
from feedloom.sources.arrays import _scanner, read_array_payload
from feedloom.sources.payload import CORRUPT, read_payload


def article(i, text):
    return dict.fromkeys(ARTICLE.names, "x") | {"source_url": str(i), "title_en": text}


TRICKY = ['"', "\\", '\\"', "\\\\", '],[{"', "}]", "é🙂", "a,b", "[", "\n\t", "\\\\\\\""]


def rows(df):
    return [(r.source_url, r.title_en, r[CORRUPT]) for r in df.orderBy("payload_file", "payload_block", "payload_row").collect()]


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
def test_splits_anywhere_give_the_rows_of_the_whole(spark, tmp_path, split):
    chance = random.Random(split)
    n = 12 if split == 7 else 150
    articles = [article(i, "".join(chance.choices(TRICKY, k=chance.randrange(6)))) for i in range(n)]
    articles[3]["summary_en"] = "long " * 300
    (tmp_path / "a.json").write_text(json.dumps(articles, ensure_ascii=False, indent=chance.choice([None, 1])))
    (tmp_path / "b.json").write_text(" [ ]\n")
    (tmp_path / "c.json").write_text(json.dumps(articles[:2]))
    (tmp_path / "d.json").write_text(json.dumps(articles[5]))
    (tmp_path / "e.json").write_text("")
    got = rows(read_array_payload(spark, str(tmp_path), split))
    assert got == [(a["source_url"], a["title_en"], None) for a in [*articles, *articles[:2], articles[5]]]
    whole = rows(read_payload(spark, str(tmp_path), array=True))
    assert sorted(map(repr, got)) == sorted(map(repr, whole))


@pytest.mark.parametrize("split", [9, 1 << 20])
def test_a_bad_element_does_not_cost_the_others(spark, tmp_path, split):
    good = [json.dumps(article(i, "t")) for i in range(3)]
    (tmp_path / "a.json").write_text(f"[{good[0]}, 7, {good[1]}, {{\"title_en\": ] , {good[2]}")
    got = rows(read_array_payload(spark, str(tmp_path), split))
    assert [g for g in got if g[2] is None] == [(str(i), "t", None) for i in range(3)]
    assert [g[2].strip() for g in got if g[2]] == ["7", '{"title_en": ]']


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    articles = [article(i, "word " * 50) for i in range(2000)]
    (tmp_path / "a.json").write_text(json.dumps(articles))
    df = read_array_payload(spark, str(tmp_path), 100_000)
    assert df.count() == 2000
    assert df.select("payload_block").distinct().count() > 5
    assert df.selectExpr("spark_partition_id() AS task").distinct().count() > 1


def test_a_split_reads_little_beyond_its_end(tmp_path, monkeypatch):
    path = tmp_path / "a.json"
    path.write_text(" \n" + json.dumps([article(i, "word " * 100) for i in range(4000)]))
    size, split, read = path.stat().st_size, 1 << 16, []

    class Counted:
        @classmethod
        def from_uri(cls, place):
            return cls(), place

        def open_input_file(self, place):
            return self

        def read_at(self, n, at):
            read.append(n)
            return path.read_bytes()[at : at + n]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    monkeypatch.setattr("pyarrow.fs.FileSystem", Counted)
    transitions, chained, elements = _scanner()
    starts = range(0, size, split)
    splits = pa.RecordBatch.from_pydict(
        {
            "payload_time": pa.array([0] * len(starts), pa.timestamp("us", "UTC")),
            "payload_file": [str(path)] * len(starts),
            "size": [size] * len(starts),
            "first": list(starts),
            "end": [min(size, first + split) for first in starts],
        }
    )
    states = chained(pa.Table.from_batches(transitions(iter([splits]))))
    assert sum(read) == size
    read.clear()
    found = pa.Table.from_batches(elements(iter(states.to_batches()))).to_pylist()
    assert [json.loads(row["text"])["source_url"] for row in found] == [str(i) for i in range(4000)]
    assert [row["payload_block"] for row in found] == sorted(row["payload_block"] for row in found)
    assert {row["payload_block"] for row in found} == set(starts)
    # Before, a split read the first MiB of the file and a MiB from where it begins.
    assert sum(read) < 1.5 * size
