"""What a worker of the token alignment holds at a time."""

from terralog.llm import token_alignment as T
from terralog.llm import worker_memory as M
from terralog.llm.lockstep import groups_text
from tests.llm.test_token_alignment import PATHS, pair, plain, text_of  # noqa: F401


def test_many_distinct_words_do_not_stay(pair, monkeypatch):  # noqa: F811
    monkeypatch.setattr(T, "MEMO_UNITS", 300, raising=False)
    monkeypatch.setattr(T, "LEARN_UNITS", 64, raising=False)
    fresh, most, batches = T.TokenPair(*PATHS), 0, []
    encode = fresh.b.encode
    monkeypatch.setattr(fresh.b, "encode", lambda units, **k: batches.append(len(units)) or encode(units, **k))
    for i in range(40):
        text = " ".join(f"w{i}x{k}" for k in range(100))
        assert groups_text(*next(T.aligned_texts(fresh, [text])), fresh.decimals).decode() == text_of(plain(pair, text))
        most = max(most, len(fresh.slot))
    assert most <= 400 and max(batches) <= 64


def test_workers_take_few_rows_at_a_time(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    n = 2500

    def counting(make):
        def made(*args):
            run = make(*args)

            def counted(batches):
                def seen():
                    for b in batches:
                        sizes.add(int(b.num_rows > M.ROWS))
                        yield b
                yield from run(seen())
            return counted
        return made
    monkeypatch.setattr(T, "_aligner", counting(T._aligner))
    monkeypatch.setattr(T, "_scorer", counting(T._scorer))
    docs = spark.range(n).coalesce(1).selectExpr("id AS doc_id", "concat('words of ', id) AS text")
    assert T.score_links(*T.align_documents(docs, *PATHS), *PATHS).count() == n
    assert sizes.value == 0
