import hashlib
import random
import re

import numpy as np

from siftwork.llm.pii import PATTERNS, base_spans, find_pii, mask_pii, reliabilities


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_against_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(["@", ".", "a", "b-", "+", "1", "25", " ", "-", "4539578763621486", "%", "(", "é", "10.0.0.1", "x@y.z", "300."]) for _ in range(rng.randrange(25)))
        assert base_spans(text) == brute(text), text
    assert base_spans("1" * 200_000 + "a" * 200_000) == []


def test_query_adds_to_the_base(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, rng.choice([f'say token = "{secret}" end', "nothing at all. Here it is", "mail a.b@c.example.com or 10.1.2.3", "+1 (555) 555-0100 now", "4539 5787 6362 1486 paid"])))
    rows += [(900, None), (901, ""), (902, "4539578763621486" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans")
    texts = dict(rows)
    for r in find_pii(df).collect():
        text = texts[r.doc_id] or ""
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in brute(text)) for x in ("email", "ip", "card", "phone")]
        assert ("secret" in r.spans) == ("token" in text)
        if "nothing" in text:
            assert r.spans == ""
    out = {r.doc_id: r.text for r in mask_pii(df).collect()}
    assert out[900] is None and all("@" not in t and "token = \"<SECRET>" in t if "token" in t else "@" not in t for t in out.values() if t)
    assert find_pii(df.limit(0)).count() == 0


def test_em_finds_the_unreliable_labeler():
    rng = np.random.default_rng(5)
    y = rng.random(20_000) < 0.4
    votes = [np.where(rng.random(len(y)) < right, y, ~y) * 2 for right in (0.9, 0.85, 0.5)]
    n = np.bincount(votes[0] * 9 + votes[1] * 3 + votes[2], minlength=PATTERNS).astype(float)
    post = reliabilities(n)
    assert post[2 * 9 + 2 * 3] > 0.9 and post[2] < 0.15
    assert abs(post[2 * 9 + 2 * 3] - post[2 * 9 + 2 * 3 + 2]) < 0.1
