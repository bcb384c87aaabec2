"""Small rigid algebra of the driver and of tasks: 3 x 3 and 6 x 6 problems whose sums Spark has aggregated."""

from __future__ import annotations

import numpy as np


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt


def from_sums(weight: float, source: np.ndarray, target: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The least-squares rigid transform from the sums of weights, of weighted sources and targets, and of their weighted
    products source_i * target_j."""
    cs, ct = source / weight, target / weight
    r = nearest_rotation((cross - np.outer(source, ct)).T)
    return matrix(r, ct - r @ cs)


def matrix(rotation: np.ndarray, shift: np.ndarray) -> np.ndarray:
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = rotation, shift
    return m


def turn(w: np.ndarray) -> np.ndarray:
    """The rotation matrix of a rotation vector."""
    angle = float(np.linalg.norm(w))
    axis = w / angle if angle > 1e-12 else np.array([1.0, 0.0, 0.0])
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def about(m: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """``m``, found in coordinates from ``centre`` on, in those from the origin on."""
    return matrix(m[:3, :3], m[:3, 3] + centre - m[:3, :3] @ centre)


def move(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    return points @ m[:3, :3].T + m[:3, 3]
