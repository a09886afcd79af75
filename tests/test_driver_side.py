import math

import pytest

from pitlane.functions import statistics as st
from pitlane.operators.ledger import Ledger, canonical_json

SERIES = [0.01, -0.005, 0.015, 0.002, -0.003] * 12


def filled(tmp_path):
    ledger = Ledger(tmp_path / "trials.jsonl")
    for f in "aabcb":
        ledger.append("backtest", strategy_fingerprint=f, strategy_name=f.upper())
    ledger.append("note", label="x" * 300)
    return ledger


def test_ledger_counts_and_chain(tmp_path):
    ledger = filled(tmp_path)
    assert ledger.summary() == {"runs": 5, "variants": 3, "names": {"a": "A", "b": "B", "c": "C"}}
    assert ledger.verify()[0] and len(ledger.entries()[-1]["label"]) == 200
    with pytest.raises(ValueError):
        ledger.append("note", colour="red")


@pytest.mark.parametrize("harm", [lambda t: t.replace('"A"', '"Z"'), lambda t: "\n".join(t.splitlines()[:-1]) + "\n", lambda t: t + "not json\n", lambda t: "\n".join(t.splitlines()[1:]) + "\n"])
def test_ledger_shows_tampering(tmp_path, harm):
    ledger = filled(tmp_path)
    ledger.path.write_text(harm(ledger.path.read_text()))
    assert not ledger.verify()[0]


def test_no_ledger(tmp_path):
    ledger = Ledger(tmp_path / "none.jsonl")
    assert ledger.verify() == (True, "no ledger") and ledger.summary()["variants"] == 1


def test_canonical_json():
    assert canonical_json({"b": math.nan, "a": (1, "é")}) == '{"a":[1,"\\u00e9"],"b":null}'


def test_sharpe_family():
    p = st.probabilistic_sharpe(SERIES)
    assert 0.5 < st.deflated_sharpe(SERIES, 20) < p <= 1
    assert st.expected_max_sharpe(SERIES, 1) == 0 < st.expected_max_sharpe(SERIES, 5) < st.expected_max_sharpe(SERIES, 50)
    assert st.minimum_track_record(SERIES) > 1 and st.minimum_track_record([-x for x in SERIES]) is None
    for short in ([], [0.1], [0.1, 0.2, 0.3], [0.0] * 9, [math.nan] * 5):
        assert st.probabilistic_sharpe(short) == 0.5 and st.minimum_track_record(short) is None


def test_resampling_is_bounded_and_repeats():
    assert 0 < st.sign_flip_p(SERIES, 200) < 0.5 and st.sign_flip_p([], 10) == 1.0
    assert st.sign_flip_p([0.01, -0.01] * 20, 200) == 1.0
    a, b = st.block_bootstrap(SERIES, 200), st.block_bootstrap(SERIES, 200)
    assert a == b and a.lower <= a.median <= a.upper and 0 <= a.probability_positive <= 1 and a.drawdown_lower <= 0
    assert st.block_bootstrap([0.1]) is None
