"""The rule scorer works a word out once and forgets words rather than grow without bound."""

from spanfold.plans import q_model as Q


def test_words_are_remembered_within_a_bound():
    Q._HITS.clear()
    assert Q.insult_share(["you Idiot!, you", "", "no no", "idiot (scum) idiotic"]) == [0.5, 0.0, 0.0, 2 / 3]
    assert set(Q._HITS) == {"you", "Idiot!,", "no", "idiot", "(scum)", "idiotic"}
    Q.insult_share([" ".join(f"w{k}" for k in range(1 << 18))])
    assert len(Q._HITS) <= 1 << 18
    assert Q.insult_share(["w1 scum"]) == [0.5]
