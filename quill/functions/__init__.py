"""Column-level building blocks (all JVM-side expressions)."""

from quill.functions.hashing import gaussian, hash_hex, hash_bucket, uniform
from quill.functions.text import squash_ws, strip_ws, tokens, control_prompt_expr
from quill.functions.arrays import (
    clip_l2,
    l2_norm,
    log_softmax,
    mask_targets,
    mask_value,
    softmax,
)

__all__ = [
    "gaussian", "hash_hex", "hash_bucket", "uniform",
    "squash_ws", "strip_ws", "tokens", "control_prompt_expr",
    "clip_l2", "l2_norm", "log_softmax", "mask_targets", "mask_value", "softmax",
]
