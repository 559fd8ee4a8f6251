"""Answers are paid for once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from feedloom.operators.enrich import enrich, enrich_capped
from feedloom.plans.harvest import harvest_to
from feedloom.sources.answers import AnswerStore
from feedloom.sources.payload import read_payload
from tests.test_plans import NOW, client, inputs


def counting(folder):
    """A model that notes every call in a folder; texts with a ``!`` fail, those with ``?`` get ``{}``."""
    os.makedirs(folder, exist_ok=True)

    def connect():
        def call(text):
            descriptor = os.open(f"{folder}/calls", os.O_CREAT | os.O_APPEND | os.O_WRONLY)
            os.write(descriptor, (json.dumps(text) + "\n").encode())
            os.close(descriptor)
            if "!" in text:
                raise ValueError(text)
            return {} if "?" in text else {"title_en": text.upper(), "title_pt": None}

        return call

    return connect


def calls(folder):
    path = f"{folder}/calls"
    found = [json.loads(line) for line in open(path)] if os.path.exists(path) else []
    if found:
        os.truncate(path, 0)
    return sorted(found)


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


def titles(df):
    return {r.id: r.answer["title_en"] if r.answer else None for r in df.collect()}


def test_each_text_is_asked_once(spark, tmp_path):
    folder, answers = str(tmp_path / "calls"), AnswerStore(str(tmp_path / "answers"))
    df = rows(spark, ["a", "b", "a", "a", "no!", "empty?", None, ""])
    got = enrich(df, counting(folder), text="text", answers=answers)
    assert calls(folder) == ["", "a", "b", "empty?", "no!"]
    want = {0: "A", 1: "B", 2: "A", 3: "A", 4: None, 5: None, 6: None, 7: ""}
    assert titles(got) == want and got.columns == ["id", "text", "answer"]
    assert calls(folder) == []
    # Failures are asked again, answers are not; an explicit null stays one.
    again = enrich(df, counting(folder), text="text", answers=answers)
    assert calls(folder) == ["empty?", "no!"]
    assert titles(again) == want
    assert again.where("id = 0").first().answer == {"title_en": "A", "title_pt": None}
    # Another model is another question.
    enrich(df.where("id = 0"), counting(folder), text="text", answers=AnswerStore(answers.path, "other"))
    assert calls(folder) == ["a"]
    assert answers.read(spark).count() == 4


@pytest.mark.parametrize("blocks", [(32, 256), (1, 2)])
def test_a_feed_takes_stored_answers_in_its_turn(spark, tmp_path, blocks):
    folder, answers = str(tmp_path / "calls"), AnswerStore(str(tmp_path / "answers"))
    texts = ["a", "no!", "b", "c", "d", "x!", "y!", "e", "f", "g"]
    df = rows(spark, texts).withColumn("feed", F.when(F.col("id") < 5, "p").otherwise("q"))

    def run():
        got = enrich_capped(df, counting(folder), feed=("feed",), order=("id",), text="text", blocks=blocks, answers=answers)
        assert got.columns == ["id", "text", "feed", "answer"]
        return titles(got)

    want = {0: "A", 2: "B", 7: "E", 8: "F"}
    assert run() == want
    assert calls(folder) == ["a", "b", "e", "f", "no!", "x!", "y!"]
    assert run() == want
    assert calls(folder) == ["no!", "x!", "y!"]


def test_many_runs_leave_few_files(spark, tmp_path):
    answers = AnswerStore(str(tmp_path / "answers"))
    folder = str(tmp_path / "calls")
    for i in range(9):
        enrich(rows(spark, [f"t{i}", f"t{i + 1}"]), counting(folder), text="text", answers=answers)
    assert calls(folder) == [f"t{i}" for i in range(10)]
    assert len(answers._runs.state(spark)["runs"]) == 3
    known = answers.known(rows(spark, [f"t{i}" for i in range(12)]).select(answers.digest(F.col("text")).alias("d"), "text"), "d", ["text"])
    assert {r.text for r in known.where("_known IS NOT NULL").collect()} == {f"t{i}" for i in range(10)}


def test_a_run_keeps_what_it_passed_over(spark, tmp_path):
    payloads, catalog = inputs(spark, tmp_path)
    path = str(tmp_path / "payload")
    harvest_to(spark, payloads, catalog, client, NOW, path)
    rejected = spark.read.json(f"{path}-rejects").collect()
    assert [(r.feed_url, r.reject) for r in rejected] == [("u3", "unreadable")]
    assert {r.source_url for r in read_payload(spark, path).collect()} == {"l2", "l3"}
    harvest_to(spark, payloads, catalog, client, NOW, path, fetched_since="2030-01-01", rejects=str(tmp_path / "r"))
    assert read_payload(spark, path).count() == 0
