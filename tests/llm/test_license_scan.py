"""Labels and scores against every template at every start, on texts with whole, cut and changed licences."""

import math
import random
import re

from faultline.llm import license_scan as ls


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts):
    docs = [words_of(t) for t in texts]
    templates = [(label, words_of(body), [words_of(k) for k in keys]) for label, body, keys in ls.TEMPLATES]
    vocabulary = {w for _, body, _ in templates for w in body} | {w for p, _ in ls.PHRASES for w in words_of(p)}
    idf = {w: math.log((len(docs) + 1) / (sum(w in d for d in docs) + 1)) + 1 for w in vocabulary}
    out = []
    for doc in docs:
        best, labels = 0.0, set()
        here = set(doc)
        for label, body, keys in templates:
            total = sum(idf[w] for w in body)
            if sum(idf[w] for w in body if w in here) / total < ls.FLOOR - 1e-9:
                continue
            anchors = [w for w in sorted(set(body), key=lambda w: (-idf[w], w)) if w in here][: max(1, math.ceil(ls.ANCHORS * len(set(body))))]
            for start in range(1 - len(body), len(doc)):
                inside = range(max(0, start), min(len(doc), start + len(body)))
                if sum(doc[i] == body[i - start] and doc[i] in anchors for i in inside) < max(1, len(anchors) // 2):
                    continue
                share = sum(idf[doc[i]] for i in inside if doc[i] == body[i - start]) / total
                best = max(best, share)
                near = doc[max(0, inside.start - len(body)) : inside.stop + len(body)]
                if share >= ls.THRESHOLD and any(near[i : i + len(k)] == k for k in keys for i in range(len(near))):
                    labels.add(label)
        out.append((min(1.0, best), labels))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(12)
    bodies = [body for _, body, _ in ls.TEMPLATES]
    filler = ["some", "code", "license", "the", "software", "x", "é"]
    texts = [None, "", "all rights reserved", "MIT", " ".join(filler)]
    for body in bodies:
        w = body.split()
        lead = " ".join(rnd.choice(filler) for _ in range(rnd.randint(0, 9)))
        texts += [f"{lead} {body} end", " ".join(w[: len(w) * 2 // 3]), " ".join(x if rnd.random() > 0.15 else rnd.choice(filler) for x in w)]
        k = rnd.randrange(len(w) + 1)
        texts.append(" ".join([*w[:k], "extra", "words", *w[k:]]))
    texts += [f"{rnd.choice(bodies)} {lead} {rnd.choice(bodies)}" for _ in range(8)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    got = {r.doc_id: r for r in ls.scan_licenses(df).collect()}
    for i, (score, labels) in enumerate(brute(texts)):
        assert abs(got[i].score - score) < 1e-9 and set(got[i].labels) - set(got[i].base_labels) == labels - set(got[i].base_labels), (texts[i], got[i], score, labels)
