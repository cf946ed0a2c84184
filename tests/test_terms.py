"""Term search by an automaton against plain containment."""

from wickerwork.operators.evidence import term_search_contained


def test_many_terms_and_phrases(spark):
    texts = [(i, f"The {i} quick Brown fox{i % 50} jumps over ß{i % 7} lazy dogs, p{i}q") for i in range(200)] + [(200, None), (201, "")]
    terms = [f"{i} quick brown fox{i % 50}" for i in range(0, 5000)] + [f"FOX{i}" for i in range(5000)] + ["quick", "ck br", "ß3 lazy", "", "  ", None, "quick"]
    df, wanted = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    low = {t.lower() for t in terms if t and t.strip()}
    want = {i: "|".join(sorted(t for t in low if t in x.lower())) for i, x in texts if x}
    for limit in (4_000_000, 30_000):
        assert {r.id: r.hits for r in term_search_contained(df, "id", "text", wanted, limit).collect()} == want
    assert term_search_contained(df, "id", "text", wanted.limit(0)).count() == 0
