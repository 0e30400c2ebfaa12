"""Sub-aperture frames of pulses, from a table or from a stream whose pulses come in any order.

Frame f of a channel has the pulses from f * step on, width of them, so frames
overlap where step is less than width.  A frame's rows are its Doppler lines:
the transform across its pulses, zero frequency in the middle, for every sample
of a pulse.  Pulses go to blocks of frames, and a block is what a task, or a
key's state, holds: block * step + width pulses at most, however long its
channel is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAMES = "channel string, frame long, line int, n int, complete boolean, re array<double>, im array<double>"
_STATE = "pulses binary, samples binary, done binary, last long"


def _dealt(pulses: DataFrame, width: int, step: int, block: int) -> DataFrame:
    """Pulses with the blocks whose frames hold them; one that lies in a gap between frames goes nowhere."""
    if min(width, step, block) < 1:
        raise ValueError("width, step and block are 1 or more")
    last = F.floor(F.col("pulse") / step)
    first = F.greatest(F.floor((F.col("pulse") - width + step) / step), F.lit(0))
    own = pulses.where("channel is not null and pulse >= 0 and re is not null and im is not null").where(first <= last)
    return own.withColumn("block", F.explode(F.sequence(F.floor(first / block), F.floor(last / block))))


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    """Samples of pulses, a row each; pulses of different length are an error, as are parts of one."""
    sizes = {len(x) for name in ("re", "im") for x in rows[name]}
    if len(sizes) > 1:
        raise ValueError(f"pulses of a channel differ in length: {sorted(sizes)}")
    return np.array(rows["re"].tolist(), dtype=float) + 1j * np.array(rows["im"].tolist(), dtype=float)


def _frame(channel: str, frame: int, pulses: np.ndarray, samples: np.ndarray, width: int, step: int) -> pd.DataFrame | None:
    """One frame of sorted pulses, those that lack as zeros; nothing if all do."""
    low, high = np.searchsorted(pulses, (frame * step, frame * step + width))
    if low == high:
        return None
    whole = np.zeros((width, samples.shape[1]), dtype=complex)
    whole[pulses[low:high] - frame * step] = samples[low:high]
    lines = np.fft.fftshift(np.fft.fft(whole, axis=0), axes=0)
    n = int(high - low)
    return pd.DataFrame({"channel": channel, "frame": frame, "line": np.arange(width), "n": n, "complete": n == width, "re": list(lines.real), "im": list(lines.imag)})


def _merged(pulses: np.ndarray, samples: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What is held together with rows, sorted; of copies of a pulse the first stays."""
    if len(rows) == 0:
        return pulses, samples
    new = _matrix(rows)
    if len(pulses) and new.shape[1] != samples.shape[1]:
        raise ValueError(f"pulses of a channel differ in length: {sorted({new.shape[1], samples.shape[1]})}")
    numbers = np.concatenate([pulses, rows["pulse"].to_numpy(np.int64)])
    numbers, first = np.unique(numbers, return_index=True)
    return numbers, (np.concatenate([samples, new]) if len(pulses) else new)[first]


def frames(pulses: DataFrame, width: int, step: int, block: int = 16) -> DataFrame:
    """(channel, frame, line, n, complete, re, im): all frames of a table of pulses (channel, pulse, re, im).

    n of a frame's pulses are there, the others count as zeros; a frame
    without any isn't a row.  Of copies of a pulse one stays, so they should
    be alike.  Rows with a null or a negative pulse take no part.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        numbers, samples = _merged(np.empty(0, np.int64), np.empty((0, 0), complex), rows)
        made = [_frame(key[0], f, numbers, samples, width, step) for f in range(key[1] * block, (key[1] + 1) * block)]
        return pd.concat([m for m in made if m is not None])

    return _dealt(pulses.select("channel", "pulse", "re", "im"), width, step, block).groupBy("channel", "block").applyInPandas(run, FRAMES)


def frames_of_stream(pulses: DataFrame, width: int, step: int, late: str, hold: float, block: int = 16) -> DataFrame:
    """The frames of a stream of pulses (channel, pulse, ts, re, im), each once: a frame goes out when its last pulse has come.

    late sets the watermark: pulses that come later than that don't count.
    hold (seconds) is how much later than a block's latest pulse another one
    of it may have been sent; once the watermark has passed that, frames that
    lack pulses go out as they are, and the block's state goes.  With late and
    hold long enough the rows are those of ``frames``.  A pulse is held until
    every frame that it belongs to has gone out.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        channel, number = key
        numbers, samples, done, last = np.empty(0, np.int64), np.empty((0, 0), complex), set(), 0
        if state.exists:
            held, data, gone, last = state.get
            numbers, done = np.frombuffer(held, np.int64), set(np.frombuffer(gone, np.int64).tolist())
            samples = np.frombuffer(data, complex).reshape(len(numbers), -1) if len(numbers) else samples
        every = range(number * block, (number + 1) * block)
        if state.hasTimedOut:
            state.remove()
            for f in every:
                made = None if f in done else _frame(channel, f, numbers, samples, width, step)
                if made is not None:
                    yield made
            return
        for rows in batches:
            last = max(last, int(rows["ts"].max().timestamp() * 1000))
            numbers, samples = _merged(numbers, samples, rows)
        for f in every:
            low, high = np.searchsorted(numbers, (f * step, f * step + width))
            if f not in done and high - low == width:
                done.add(f)
                yield _frame(channel, f, numbers, samples, width, step)
        use = np.zeros(len(numbers), dtype=bool)
        for f in every:
            if f not in done:
                use |= (numbers >= f * step) & (numbers < f * step + width)
        numbers, samples = numbers[use], samples[use]
        state.update((numbers.tobytes(), samples.tobytes(), np.array(sorted(done), np.int64).tobytes(), last))
        state.setTimeoutTimestamp(max(last + int(hold * 1000), state.getCurrentWatermarkMs() + 1))

    own = _dealt(pulses.select("channel", "pulse", "ts", "re", "im").where("ts is not null").withWatermark("ts", late), width, step, block)
    return own.groupBy("channel", "block").applyInPandasWithState(run, FRAMES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
