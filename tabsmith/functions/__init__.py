"""Scalar column expressions (JVM-side, codegen friendly)."""

from tabsmith.functions.scalar import *  # noqa: F401,F403
