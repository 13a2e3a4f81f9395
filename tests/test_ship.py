"""Functions for the Python workers travel with the job, not by module name."""

import pickle

from pyspark import cloudpickle

from urlrisk.operators.ttl import fresh_positions


def test_worker_functions_are_sent_by_value():
    data = cloudpickle.dumps(lambda: fresh_positions([0, 5, 10], 10, None))
    assert b"urlrisk.operators.ttl\x94\x8c\x0ffresh_positions" not in data
    assert pickle.loads(data)() == ([0, 2], 10)
