from multitopic.operators import skew
from multitopic.sources import corpus as C


def test_frequent_terms_are_met_without_a_shuffle(spark, monkeypatch):
    rows = [(d, 0, f"w{d % 3}", 1.0) for d in range(300)] + [(d, 1, f"é{d}", 2.0) for d in range(300)]
    terms = spark.createDataFrame(rows, "doc_id bigint, type_id int, term string, cnt double")
    vocab = C.vocabulary(terms).checkpoint()
    want = sorted(map(tuple, terms.join(vocab, ["type_id", "term"]).select("doc_id", "type_id", "term_id", "cnt").collect()))
    split, hot = skew.split_join, []
    monkeypatch.setattr(skew, "split_join", lambda *a: hot.append(a[3]) or split(*a))
    for limit, n in ((1 << 20, 303), (100, 3), (10, None)):
        monkeypatch.setattr(C, "FREQUENT_BYTES", limit)
        assert sorted(map(tuple, C.encode(terms, vocab).collect())) == want
        assert n is None or hot[-1].count() == n
