"""Very long runs in one text: every lane of the scan comes from another state than it assumed."""

import random
import re

import numpy as np
import pytest

from annalist.llm import automaton, secret_scan


def plain(dfa, data, starts):
    out, state, begins = [], 0, set(starts.tolist())
    for i, b in enumerate(data.tolist()):
        if i in begins:
            state = 0
        state = int(dfa.step[state, b])
        out.append(int(dfa.accepts[state]))
    return out


@pytest.mark.parametrize("few", [1, 48])
def test_scan_equals_one_step_a_byte(monkeypatch, few):
    monkeypatch.setattr(automaton, "LANE", 7)
    monkeypatch.setattr(automaton, "FEW", few)
    rng = random.Random(few)
    dfa = automaton.Dfa([r"a+@", r"(?i:key)=[a-z]{3,}", r"[0-9a-f]+"], backwards=True)
    for _ in range(60):
        texts = [rng.choice(["a" * rng.randrange(1, 90), "@" + "a" * 50 + "KEY=" + "b" * 40, "xyz" * 20, "".join(rng.choice("ak@e=yKEY01 f") for _ in range(rng.randrange(1, 70)))]) for _ in range(5)]
        data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        starts = np.append(0, np.cumsum([len(t) for t in texts]))[:-1]
        assert automaton.scan(dfa, data, starts).tolist() == plain(dfa, data, starts)


@pytest.mark.parametrize("text", ["a" * 2_000_000 + "@", "https://u:" + "p" * 300_000 + "@h x", "f" * 1_000_000, "token=" + "x" * 500_000 + " end"])
def test_base_secrets_of_long_runs(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    found = {(secret_scan.RULES[k].kind, s, e) for s, k, e in secret_scan.Scanner().spans(data, np.array([0, len(data)]))[0]}
    want = {("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24} | {("assign", m.start(), m.end()) for m in re.finditer(r"token=([A-Za-z0-9+/_.=-]+)", text)}
    assert want <= found and {f for f in found if f[0] in ("hex", "assign", "access")} == want
