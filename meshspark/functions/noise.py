"""Synthetic fields of a given spectral slope."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def red_noise(values: Column, nx: int, ny: int, power: float = 1.5) -> Column:
    """White noise (an array of nx * ny numbers, x-major) whose amplitudes fall with the wavenumber's ``power``; its mean goes.

    1.5 gives a spectrum of slope -2.  A null array stays null; another length raises.
    """
    k = np.hypot(np.fft.fftfreq(nx)[:, None] * nx, np.fft.fftfreq(ny)[None, :] * ny)
    k[0, 0] = np.inf

    @F.pandas_udf("array<double>")
    def redden(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        known = v.notna().to_numpy().nonzero()[0]
        if len(known):
            white = np.stack([np.asarray(v.iloc[i], dtype=float) for i in known]).reshape(-1, nx, ny)
            red = np.real(np.fft.ifft2(np.fft.fft2(white) * k**-power)).reshape(len(known), -1)
            for i, r in zip(known, red):
                out.iat[i] = r
        return out

    return redden(values)
