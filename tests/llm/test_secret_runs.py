"""Which random runs the secret scan finds."""

import random
import string

from citeframe.llm import secretscan


def _told(text, kind="random"):
    return [text[a:b] for k, a, b in secretscan.spans(text) if k == kind]


def test_short_and_digitless_runs():
    assert _told("see 7dKq2ZxP0vLmW9sY here") == ["7dKq2ZxP0vLmW9sY"]
    assert _told("see qZxKvJpWbYtXmQfGkHzR here") == ["qZxKvJpWbYtXmQfGkHzR"]
    rnd = random.Random(3)
    prose = "The committee published the preliminary recommendations yesterday. " * 20
    for alphabet in (string.ascii_letters + string.digits, string.ascii_letters):
        runs = ["".join(rnd.choice(alphabet) for _ in range(18)) for _ in range(200)]
        assert sum(_told(f"{prose} {r} {prose}") == [r] for r in runs) > 140


def test_ordinary_runs():
    text = "TERMS AND CONDITIONS OF THE INTERNATIONAL AGREEMENT, quequejarse Quarterly getElementById 20240229 2024-02-29T12 0123456789012345678 ================ ________ https://example.com/en/internationalization Geschwindigkeitsbegrenzung"
    assert _told(text) == [] and _told(text.upper()) == [] and _told(text.lower()) == []


def test_runs_beyond_known_shapes():
    run = "3f9a0c7be2d41586-7dKq2ZxP0vLmW9sYtB4nRj8HcE5uGfA1iOoXpQwV"
    found = secretscan.spans(f"see {run} here")
    assert found == [("hex", 4, 20), ("random", 4, 4 + len(run))] or found == [("random", 4, 4 + len(run)), ("hex", 4, 20)]
    assert secretscan.redacted(f"see {run} here", found) == "see <secret> here"
    assert [k for k, *_ in secretscan.spans("token=7dKq2ZxP0vLmW9sYtB4nRj8HcE5uGfA1")] == ["assign"]
    assert secretscan._covered(2, 9, [(0, 4), (1, 3), (4, 9)]) and not secretscan._covered(2, 9, [(0, 4), (5, 9)])
