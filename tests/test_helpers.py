from __future__ import annotations

import json
import logging

from skein import helpers as h


def test_helpers():
    assert h.deep_merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "d": {"x": 1}}) == {"a": {"b": 5, "c": 2}, "d": {"x": 1}}
    with h.Timer() as t:
        pass
    assert t.seconds >= 0
    assert h.Settings.from_env({"SKEIN_TOP_K": "3", "SKEIN_THRESHOLD": "0.5", "OTHER": "1"}) == h.Settings(top_k=3, threshold=0.5)
    record = logging.makeLogRecord({"msg": "said %s", "args": ("x",), "levelname": "INFO", "name": "skein", "doc": 7})
    assert json.loads(h.JsonFormatter().format(record)) | {"time": ""} == {"time": "", "level": "INFO", "logger": "skein", "message": "said x", "doc": 7}
    assert h.json_logging().handlers
