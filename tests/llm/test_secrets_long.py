import base64
import hashlib

from foliospark.llm import secrets

from .conftest import frame


def test_runs_of_any_length_are_candidates(spark):
    blob = base64.b64encode(b"".join(hashlib.sha256(bytes([k])).digest() for k in range(250))).decode()
    keys = [blob[:n] for n in (16, 512, 513, 600, 5000)] + ["0a" * 100_000]
    texts = [f'private_key = "{k}" end' for k in keys]
    got = {r.doc_id: r for r in secrets.scan(frame(spark, texts)).collect()}
    assert sorted(got) == list(range(len(keys)))
    assert [(got[d].start, got[d].end, got[d].candidate_sha256) for d in got] == [(15, 15 + len(keys[d]), hashlib.sha256(keys[d].encode()).hexdigest()) for d in got]
    assert all(got[d].secret for d in (1, 2, 3, 4))
