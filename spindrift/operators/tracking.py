"""The derived tracking dataset: angles of head and body, their derivatives, and the animal's own motion, frame by frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators import geometry, windows

ANGLES = ("roll", "pitch", "azimuth", "azimuth_planar", "back_pitch", "back_azimuth")


def head_angles(body: geometry.Vector, head_x: geometry.Vector, head_z: geometry.Vector, up_limit: float | None = None, least: float = 0.001) -> dict[str, Column]:
    """Degrees by name: the head's roll, pitch and azimuth in the body's frame, its azimuth in the planar frame, and the back's angles.

    With ``up_limit`` roll and azimuth are null where the head's axis points further up or down.
    Body vectors that aren't longer than ``least``, 1 mm of a tracked body, have no frame.
    """
    frame, planar, head = geometry.body_frame(body, least), geometry.planar_frame(body, least), geometry.head_frame(head_x, head_z)
    ego3, ego2 = geometry.euler_angles(geometry.relative(frame, head)), geometry.euler_angles(geometry.relative(planar, head))
    pitch, azimuth = geometry.back_angles(geometry.times(frame, head_x))
    roll3, azimuth3 = -ego3[0], ego3[2]
    if up_limit is not None:
        size = F.sqrt(sum((c * c for c in head_x), F.lit(0.0)))
        roll3, azimuth3 = geometry.valid_angles(roll3, azimuth3, head_x[2] / size, up_limit)
    return {name: F.degrees(c) for name, c in zip(ANGLES, (roll3, ego3[1], azimuth3, ego2[2], pitch, azimuth), strict=True)}


def derived(frames: DataFrame, keys: list[str], fps: float, half: int = 5, motion_frames: tuple[int, ...] = (18, 30), order: str = "frame") -> DataFrame:
    """``frames`` (keys, order, the ``ANGLES`` in degrees, x, y) with derivatives and motion.

    Each angle gets ``_der1`` and ``_der2``, by differences over ``half`` frames to each side,
    wrapped once; each window of ``motion_frames`` gets ``jump_n``, ``cum_n``, ``dx_n``, ``dy_n``,
    by the planar azimuth. All windows run over one sort of each session.
    """
    found = frames
    for name in ANGLES:
        found = windows.derivative(found, keys, half, fps, order, name, angle=True).withColumnsRenamed({"der1": f"{name}_der1", "der2": f"{name}_der2"})
    found = found.withColumn("direction", F.col("azimuth_planar"))
    for n in motion_frames:
        found = windows.self_motion(found, keys, n, fps, order).withColumnsRenamed({c: f"{c}_{n}" for c in ("jump", "cum", "dx", "dy")})
    return found.drop("direction")
