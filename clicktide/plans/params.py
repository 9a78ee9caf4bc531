"""Training parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CGParams:
    """Defaults are fixed values shared with existing model configurations."""

    eps: float = 1e-6
    """stop when the weights move less than this (L2 norm)"""
    lam: float = 0.1
    """L2 penalty: the objective is total log loss + lam/2 w.w, bias included"""
    max_iter: int = 100
    """full-batch rounds, or passes over all mini-batches"""
    batch_size: int = 1000
    inner_iter: int = 10
    """rounds per mini-batch"""
    scale: int = 1
    """divides gradient and curvature; 0 stands for the number of samples"""
    restart_tol: float = 1e-10
    """restart with steepest descent when |g_old . mu| is below this"""
    restart_relative: bool = False
    """measure it against |g_old| |mu| instead of absolutely"""
