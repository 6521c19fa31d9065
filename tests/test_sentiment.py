from panelwright.operators import sentiment as st


def test_polarity_with_negation(spark):
    texts = [
        (1, "Profits rise, a strong record."), (2, "The losses are not good"), (3, "No losses, never weak"), (4, "not in the least was it good"), (5, ""), (6, None), (7, "the cat"),
        (8, "Growth without fraud"),
    ]
    got = {r.id: (round(r.positive_prob, 6), round(r.negative_prob, 6), r.label) for r in st.score_with_polarity(spark.createDataFrame(texts, "id int, text string"), "text").collect()}
    assert got[1] == (0.8, 0.0, "positive") and got[2] == (0.0, round(2 / 3, 6), "negative") and got[3] == (round(2 / 3, 6), 0.0, "positive")
    assert got[4] == (0.5, 0.0, "positive")  # the negator is too far away
    assert got[5] == got[6] == got[7] == (0.0, 0.0, "neutral") and got[8] == (round(2 / 3, 6), 0.0, "positive")
