"""Run configuration."""

from __future__ import annotations

import dataclasses
import hashlib
import json

from .schema import FPS, NORMAL_ACTIONS


@dataclasses.dataclass(frozen=True)
class TrackConfig:
    """Defaults equal the published configuration of the two score models."""

    normal_action_ids: tuple[int, ...] = NORMAL_ACTIONS
    val_split: float = 0.2
    random_seed: int = 42
    fps: int = FPS
    seq_len: int = 16
    seq_stride: int = 8
    noise_std: float = 0.05
    feature_layer: int = 9
    feature_input_size: int = 224
    hidden_dim: int = 128
    latent_dim: int = 32
    epochs: int = 50
    learning_rate: float = 1e-3
    flat_batch_size: int = 64
    sequence_batch_size: int = 32

    def canonical_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True, separators=(",", ":"))

    def sha256(self) -> str:
        return hashlib.sha256(self.canonical_json().encode()).hexdigest()
