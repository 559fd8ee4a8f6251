"""What a stream that remembers every URL gives to Python at once."""

from feedloom.streaming import unique
from tests.test_landing import land, line, titles
from tests.test_unique import run


def test_batches_of_long_texts_are_bounded(spark, tmp_path, monkeypatch):
    news, n = str(tmp_path / "news"), 2000
    land(tmp_path / "in", "a.json", 100, *[line(str(i), str(i) + "x" * 10_000) for i in range(n)])
    real = unique._one_per_batch

    def checked(key, order):
        reduce = real(key, order)

        def tell(batches):
            for batch in batches:
                assert batch.nbytes < 8 << 20, f"a batch has {batch.nbytes} bytes"
                yield batch

        return lambda batches: reduce(tell(batches))

    monkeypatch.setattr(unique, "_one_per_batch", checked)
    run(spark, tmp_path / "in", news, tmp_path / "cp")
    assert {url: title.rstrip("x") for url, title in titles(spark, news).items()} == {str(i): str(i) for i in range(n)}
    assert spark.conf.get(unique._BATCH_BYTES) != unique._CONF[unique._BATCH_BYTES]
