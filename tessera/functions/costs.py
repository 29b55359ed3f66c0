"""Column builders for costs, scores, shifts and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import clip, dot, norm


@dataclass(frozen=True)
class MatchParams:
    """Options of the matcher."""

    top_k: int = 20
    lambda_switch: float = 0.08
    lambda_jump: float = 0.15
    lambda_self: float = 0.03
    lambda_concat: float = 0.55
    lambda_join: float = 0.70
    lambda_duration: float = 0.12
    lambda_balance: float = 0.0
    balance_iters: int = 1
    jump_norm_s: float = 2.0
    hop_s: float = 0.22
    per_song_k: int = 4
    max_share: float = 1.0
    min_run: int = 1
    n_layers: int = 1
    layer_primary_weight: float = 0.62
    fidelity_first: bool = True


def duration_cost(source_s: Column, target_s: Column, weight: float = 0.12) -> Column:
    """Weighted log ratio of lengths, each of .02 s at least, at most 1.5."""
    return weight * clip(F.abs(F.log(F.greatest(source_s, F.lit(0.02)) / F.greatest(target_s, F.lit(0.02)))), 0.0, 1.5)


def discontinuity(a: str, b: str) -> Column:
    """1 less the weighted likeness of two rows' harmony, timbre and dynamics (struct columns a and b)."""
    return 1 - (0.40 * dot(f"{a}.chroma", f"{b}.chroma") + 0.40 * dot(f"{a}.timbre", f"{b}.timbre") + 0.20 * dot(f"{a}.energy", f"{b}.energy"))


def join_distance(a: Column, b: Column, tail: str, head: str) -> Column:
    """How little a's end is like b's beginning; 0 from a row to itself or without fingerprints."""
    return F.when(a == b, F.lit(0.0)).otherwise(F.coalesce(F.greatest(F.lit(0.0), 1 - dot(tail, head)), F.lit(0.0)))


def transition_cost(same_song: Column, same_row: Column, a_start: Column, b_start: Column, step: Column, concat: Column, join: Column, p: MatchParams = MatchParams()) -> Column:
    """Cost of playing b after a: a bonus where b goes on where a would, else the edges' costs and those of switching, jumping or repeating."""
    step = F.when(step > 1e-4, step).otherwise(F.lit(p.hop_s))
    off = F.abs(a_start + step - b_start)
    goes_on = same_song & (off < F.greatest(F.lit(0.06), step * 0.55))
    moved = F.when(same_song, p.lambda_jump * F.least(F.lit(1.0), off / p.jump_norm_s)).otherwise(F.lit(p.lambda_switch))
    again = F.when(same_row, F.lit(p.lambda_self)).otherwise(F.lit(0.0))
    return F.when(goes_on, F.lit(-0.28) + 0.10 * concat + 0.10 * join).otherwise(concat + join + moved + again)


def key_jump(a: Column, b: Column) -> Column:
    return 0.06 * F.least(F.lit(6), F.abs(a - b))


def role(register: str, energy: str) -> Column:
    """bass, drums, harmonic or full, by register and dynamics; absent elements are 0."""

    def at(x: str, i: int) -> Column:
        return F.coalesce(F.get(F.col(x), F.lit(i)), F.lit(0.0))

    low = F.when(F.size(register) >= 2, at(register, 0) + at(register, 1)).otherwise(F.lit(0.0))
    high = F.coalesce(F.element_at(register, -1), F.lit(0.0))
    onset, flat = at(energy, 5), at(energy, 4)
    return (
        F.when(F.col(register).isNull(), "full")
        .when((low > 0.55) & (onset < 0.45), "bass")
        .when((onset > 0.55) | ((high > 0.4) & (onset > 0.35)) | (flat > 0.55), "drums")
        .when((low < 0.35) & (onset < 0.4), "harmonic")
        .otherwise("full")
    )


def residual_fill(target: str, primary: str, other: str) -> Column:
    """How much of what primary lacks of target's harmony the other has."""
    missing = F.zip_with(target, primary, lambda t, p: F.greatest(F.lit(0.0), t - p))
    n = norm(missing)
    return F.when(n < 1e-6, F.lit(0.0)).otherwise(dot(missing, F.col(other)) / n)


def complementarity(sim: Column, timbre_overlap: Column, fill: Column, primary_role: Column, other_role: Column) -> Column:
    bonus = (
        F.when((primary_role == "bass") & (other_role == "bass"), F.lit(-0.25))
        .when((primary_role == "drums") & (other_role == "drums"), F.lit(-0.12))
        .when((other_role != primary_role) & (other_role != "full"), F.lit(0.18))
        .otherwise(F.lit(0.0))
    )
    return 0.50 * F.greatest(F.lit(0.0), sim) + 0.18 * (1 - clip(timbre_overlap, 0.0, 1.0)) + 0.22 * fill + bonus


def fold_shift(shift: Column, role_: Column) -> Column:
    """Semitones folded into -6 to 6 (both kept); drums move by a third at most, and not at all from 1.5 on."""
    turns = F.when(shift > 6, F.ceil((shift - 6) / 12)).when(shift < -6, -F.ceil((-6 - shift) / 12)).otherwise(F.lit(0))
    s = shift - 12 * turns
    return F.when(role_ == "drums", F.when(F.abs(s) >= 1.5, F.lit(0.0)).otherwise(clip(s, -0.35, 0.35))).otherwise(s)


def pitch_delta(source_hz: Column, reference_hz: Column) -> Column:
    """Semitones from source to reference; far ones folded by octaves, null where still far or a pitch is missing."""
    d = 12 * F.log2(reference_hz / source_hz)
    # over an octave and more off is taken for an octave error
    folded = F.when(F.abs(d) > 14, fold_shift(d, F.lit("full"))).otherwise(d)
    usable = (source_hz > 0) & (reference_hz > 0)
    return F.when(usable & ~((F.abs(d) > 14) & (F.abs(folded) > 8)), folded)


def pitch_steps(role_: Column, key_shift: Column, cents: Column, source_hz: Column, reference_hz: Column) -> Column:
    """Drums by key only; else by pitches where both are known, within an octave; else by key and tuning."""
    by_pitch = clip(12 * F.log2(reference_hz / source_hz), -12.0, 12.0)
    by_key = fold_shift(key_shift, role_)
    tuned = by_key + F.when(F.abs(cents) > 0.5, cents / 100).otherwise(F.lit(0.0))
    return F.when(role_ == "drums", by_key).when(source_hz.isNotNull() & reference_hz.isNotNull() & (source_hz > 1e-6), by_pitch).otherwise(tuned)


def quality_score(chroma: Column, onset: Column, log_mel: Column, boundary: Column) -> Column:
    return 0.48 * chroma + 0.29 * onset - 0.18 * F.least(F.lit(2.0), log_mel) / 2 - 0.05 * F.least(F.lit(1.0), boundary)


def improves(base: str, other: str, gain: float = 0.02) -> Column:
    """Whether metrics struct `other` is better than `base` by the score and materially worse in nothing."""
    names = ("chroma", "onset", "log_mel", "boundary")
    b, c = ([F.col(f"{x}.{n}") for n in names] for x in (base, other))
    return (
        (c[0] + 0.005 >= b[0])
        & (c[1] + 0.03 >= b[1])
        & (c[2] <= 1.05 * b[2])
        & (c[3] <= F.greatest(b[3] + 0.02, 1.5 * b[3]))
        & (quality_score(*c) >= quality_score(*b) + gain)
    )


def fade_in(i: Column, n: Column) -> Column:
    """Equal-power rise: its end point is left out."""
    return F.sin(F.pi() / 2 * i / n)


def fade_out(i: Column, n: Column) -> Column:
    """Equal-power fall: its end point is in."""
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.cos(F.pi() / 2 * i / (n - 1)))
