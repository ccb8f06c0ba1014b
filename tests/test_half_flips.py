"""Half flips on small hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from kairoframe.functions import columns as C
from kairoframe.operators import half_flips as H

SCHEMA = "match_id long, player_id long, team int, frame long, ms long, in_play boolean, dodging boolean, fx double, fy double, fz double, vx double, vy double, spin double"
TURN = [0, 60, 120, 180, 180, 180, 180, 180, 180]  # degrees, from the dodge's first frame on
NOSE_UP = {1: 45, 2: 60, 3: 45}


def flips(spark, turn=TURN, up=NOSE_UP, start=3, idle=(), dodges=None, spin=100.0, velocity=(-500.0, 0.0), tilted=0, n=14):
    rows = []
    for f in range(1, n + 1):
        yaw = math.radians(turn[min(max(f - start, 0), len(turn) - 1)])
        pitch = math.radians(up.get(f - start, tilted if f < start else 0))
        dodging = f in (dodges or (start, start + 1))
        rows.append((1, 1, 0, f, f * 100, f not in idle, dodging, math.cos(pitch) * math.cos(yaw), math.cos(pitch) * math.sin(yaw), math.sin(pitch), *velocity, spin))
    return [(r.start_frame, r.frame) for r in H.half_flips(spark.createDataFrame(rows, SCHEMA)).collect()]


def test_turned_around_and_kept(spark):
    assert flips(spark) == [(3, 10)]
    assert flips(spark, turn=[0, 60, 100, 100]) == []  # not far enough
    assert flips(spark, up={}) == []  # without a flip
    assert flips(spark, turn=[0, 60, 120, 180, 70, 180, 180, 180]) == []  # turned back between
    assert flips(spark, turn=[0, 60, 120, 180, 180, 180, 180, 90, 90]) == []  # turned back at the evaluation
    assert flips(spark, turn=[0, 60, 120, 180, 180, 180, 180, 180, 90]) == [(3, 10)]  # or after it


def test_cut_off(spark):
    assert flips(spark, idle=(6,)) == []  # a stoppage forgets the candidate
    assert flips(spark, dodges=(3, 6)) == []  # another dodge takes its place, from where the nose does not turn
    assert flips(spark, n=7) == [(3, 7)]  # judged at the recording's end
    assert flips(spark, n=4) == []


def test_tumbling_before_the_dodge(spark):
    assert flips(spark, spin=300.0) == [(3, 10)]  # backwards on purpose
    assert flips(spark, spin=300.0, velocity=(500.0, 0.0)) == []
    assert flips(spark, tilted=40, velocity=(500.0, 0.0)) == []
    assert flips(spark, velocity=(500.0, 0.0)) == [(3, 10)]


@pytest.mark.parametrize("yaw,pitch", [(0.0, 0.0), (1.0, 0.4), (3.0, -1.2)])
def test_nose_of_a_product_of_turns(spark, yaw, pitch):
    zero, one = F.lit(0.0), F.lit(1.0)
    q = C.product(C.axis_angle((zero, zero, one), F.lit(yaw)), C.axis_angle((zero, one, zero), F.lit(pitch)))
    got = spark.range(1).select(*H.nose(q)).first()
    want = (math.cos(pitch) * math.cos(yaw), math.cos(pitch) * math.sin(yaw), -math.sin(pitch))
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))
