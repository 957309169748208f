"""A clause is read without an object for every token."""

from annalist.functions import wording

TEXT = "Visto l’atto, ORDINA a partire dalle ore 8.30 del giorno 3 marzo 2026, fino a revoca: la chiusura dell’area. AVVERTE"


def test_tokens_are_made_when_they_are_asked_for(monkeypatch):
    found = wording.clause(TEXT)
    assert found["condition"] == "fino a revoca" and found["dispositions"] == [{"ordinal": 1, "kind": "closure", "text": "la chiusura dell’area."}]
    monkeypatch.setattr(wording, "tokens", lambda text: 1 / 0)  # phrases are known by now
    assert wording.clause(TEXT) == found and wording.clause("COORDINA") is None and wording.clause("") is None


def test_words_and_places_are_those_of_the_tokens():
    r = wording.Reader("L’İ n° 12_x\nD'a ’b ORDINA")
    assert r.words == [t.text for t in r.tokens] and r.raws == [t.raw for t in r.tokens] and r.spans == [(t.start, t.end) for t in r.tokens] and len(r) == len(r.tokens)
