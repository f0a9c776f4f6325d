"""What is sent to executors must not need this package there."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from skeinwork.llm import knn, language, names, neardup, packing, pii, split, tokens

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIST = pa.array([[1, 2, 3], [4]], pa.list_(pa.int64()))
TEXTS = pa.array(["Write to a.b@c.example now.", "plain words of a text"])
NO = pa.array([1, 2], pa.int32())
SAMPLES = [("en", "the service stops here"), ("de", "der Dienst endet hier"), ("nl", "de dienst stopt hier"), ("fr", "le service finit ici"), ("es", "el servicio termina"), ("pt", "o serviço acaba aqui"), ("it", "il servizio finisce qui"), ("pl", "usługa kończy się")]


def batch(*columns):
    return pa.RecordBatch.from_arrays([*columns], [f"c{i}" for i in range(len(columns))])


def works():
    model = language.fit(SAMPLES)
    unit = pa.array(np.eye(8, dtype=np.float32)[:2].tolist(), pa.list_(pa.float32()))
    lists = knn.fitted(np.eye(8, dtype=np.float32), 8)
    ids, hashes = pa.array([b"1", b"2"]), pa.array([1, 2], pa.int64())
    yield lambda: list(knn._route(iter([batch(ids, unit, hashes, hashes)]), 8, lists, 2, 0.5))
    yield lambda: list(neardup._sign(iter([batch(ids, LIST)]), 4, 2, 1))
    yield lambda: list(split._split(iter([batch(TEXTS, pa.array([["ab cd"], ["x"]]))]), 10, 2))
    yield lambda: list(pii._extract(iter([batch(TEXTS, NO, TEXTS)])))
    yield lambda: list(names._keys(iter([batch(TEXTS)])))
    yield lambda: list(tokens._count(iter([batch(NO, TEXTS)]), tokens.RANKS))
    yield lambda: list(language._classify(iter([batch(hashes, TEXTS, TEXTS)]), model))
    yield lambda: packing.pack([1, 2, 3])[0]


@pytest.mark.parametrize("n", range(8))
def test_runs_without_the_package(n, tmp_path):
    work = list(works())[n]
    (tmp_path / "work").write_bytes(cloudpickle.dumps(work))
    code = "import sys; sys.path = [p for p in sys.path if p]; from pyspark import cloudpickle; assert cloudpickle.loads(open('work', 'rb').read())(); assert not any(m.startswith('skeinwork') for m in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]
