"""Array operators on frames. Decoding and detection are plug-ins; what is here needs numpy only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, K, MIN_STD = 0.02, 4.0, 6.0


class BackgroundModel:
    """Running mean and variance of each pixel; pixels far from the mean are foreground and don't update it. With a mask, only its pixels score."""

    def __init__(self, alpha: float = ALPHA, k: float = K, min_std: float = MIN_STD, mask: np.ndarray | None = None):
        self.alpha, self.k, self.min_std, self.mean, self.var = alpha, k, min_std, None, None
        self.mask = None if mask is None else np.asarray(mask, dtype=bool)

    def score(self, frame: np.ndarray) -> float:
        """Share of foreground pixels (of the mask's); the first frame sets the model and scores 0."""
        x = np.asarray(frame, dtype=np.float64)
        if self.mean is None:
            self.mean, self.var = x.copy(), np.full_like(x, self.min_std**2)
            return 0.0
        far = np.abs(x - self.mean) > self.k * np.maximum(np.sqrt(self.var), self.min_std)
        calm = ~far
        self.mean[calm] += self.alpha * (x[calm] - self.mean[calm])
        self.var[calm] += self.alpha * ((x[calm] - self.mean[calm]) ** 2 - self.var[calm])
        if self.mask is None:
            return float(far.mean())
        return float((far & self.mask).sum() / max(1, self.mask.sum()))


def opened(mask: np.ndarray) -> np.ndarray:
    """A 3 x 3 opening: foreground that no 3 x 3 square of foreground covers goes. Beyond the edges nothing is taken away."""

    def squares(m: np.ndarray, fill: bool, join) -> np.ndarray:
        p = np.pad(m, 1, constant_values=fill)
        return join.reduce([p[y : y + m.shape[0], x : x + m.shape[1]] for y in range(3) for x in range(3)])

    return squares(squares(np.asarray(mask, dtype=bool), True, np.logical_and), False, np.logical_or)


def shrunk(frame: np.ndarray, by: int) -> np.ndarray:
    """Means of ``by`` x ``by`` pixels; a rest at the edges is left out."""
    h, w = max(1, frame.shape[0] // by), max(1, frame.shape[1] // by)
    return np.asarray(frame, dtype=np.float64)[: h * by, : w * by].reshape(h, min(by, frame.shape[0]), w, min(by, frame.shape[1])).mean(axis=(1, 3))


class MixtureModel:
    """A mixture of Gaussians for each pixel: a frame's pixel is foreground unless a component of the background explains it.

    The learning rate is 1 / frames, at least 1 / ``history``. Components are ordered by weight; those that make up
    ``share`` of the weight are background. Scores are shares of the mask's pixels after a 3 x 3 opening.
    """

    def __init__(self, mask: np.ndarray | None = None, threshold: float = 16.0, downscale: int = 1, components: int = 5, history: int = 500, share: float = 0.9, first_var: float = 15.0, bounds: tuple[float, float] = (4.0, 75.0), fit: float = 9.0):
        self.by, self.k, self.history, self.share = max(1, downscale), components, history, share
        self.threshold, self.fit, self.first_var, self.bounds, self.frames = threshold, fit, first_var, bounds, 0
        self.mask = None if mask is None else (shrunk(np.asarray(mask, dtype=float), self.by) >= 0.5 if self.by > 1 else np.asarray(mask, dtype=bool))

    def score(self, frame: np.ndarray) -> float:
        x = shrunk(frame, self.by) if self.by > 1 else np.asarray(frame, dtype=np.float64)
        if not self.frames:
            self.w, self.mean, self.var = (np.zeros((self.k, *x.shape)) for _ in range(3))
            self.var[:] = self.first_var
        self.frames += 1
        rate = 1.0 / min(self.frames, self.history)
        used = self.w > 0
        far = np.where(used, (x - self.mean) ** 2 / self.var, np.inf)
        ahead = np.cumsum(self.w, axis=0) - self.w  # weight of the components before each
        background = ((far < self.threshold) & (ahead < self.share)).any(axis=0)
        near = far < self.fit
        owner = np.where(near.any(axis=0), near.argmax(axis=0), -1)
        mine = np.arange(self.k).reshape(-1, *[1] * x.ndim) == owner
        self.w = (1 - rate) * self.w + rate * mine
        step = np.where(mine, rate / np.maximum(self.w, 1e-12), 0.0)
        gap = x - self.mean
        self.mean = self.mean + step * gap
        self.var = np.where(mine, np.clip(self.var + step * (gap**2 - self.var), *self.bounds), self.var)
        new = owner < 0  # the weakest component starts again at this pixel
        last = np.arange(self.k).reshape(-1, *[1] * x.ndim) == self.w.argmin(axis=0)
        at = new & last
        self.w, self.mean, self.var = np.where(at, rate, self.w), np.where(at, x, self.mean), np.where(at, self.first_var, self.var)
        self.w = self.w / self.w.sum(axis=0)
        order = np.argsort(-self.w, axis=0, kind="stable")
        self.w, self.mean, self.var = (np.take_along_axis(v, order, axis=0) for v in (self.w, self.mean, self.var))
        found = ~background if self.mask is None else ~background & self.mask
        if found.ndim == 2:
            found = opened(found)
        return float(found.sum() / max(1, found.size if self.mask is None else self.mask.sum()))


def background_scores(frames: DataFrame, chain: str = "camera", pixels: str = "pixels", model: Callable[[], BackgroundModel] = BackgroundModel) -> DataFrame:
    """(chain, idx, score) of ordered frames. The model depends on all frames before, so a chain is one ordered group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = model()
        pdf = pdf.sort_values("idx")
        return pd.DataFrame({chain: key[0], "idx": pdf["idx"].to_numpy(), "score": [m.score(x) for x in pdf[pixels]]})

    kind = frames.schema[chain].dataType.simpleString()
    return frames.select(chain, "idx", pixels).groupBy(chain).applyInPandas(run, f"{chain} {kind}, idx long, score double")


def foreground_share(mask: Column, region: Column) -> Column:
    """Share of a region's pixels that are foreground; both are arrays of 0 and 1."""
    inside = F.aggregate(region, F.lit(0).cast("long"), lambda a, x: a + x)
    both = F.aggregate(F.zip_with(mask, region, lambda m, r: m * r), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(inside > 0, both / inside).otherwise(F.lit(0.0))


def gaussian_kernel(sigma: float) -> np.ndarray:
    """Normalised kernel of radius round(3 sigma)."""
    r = max(1, int(round(3 * sigma)))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def blur(values: Column, sigma: float) -> Column:
    """One-dimensional Gaussian blur of an array column with zeros beyond its ends, as a higher-order expression."""
    kernel = gaussian_kernel(sigma).tolist()
    r = len(kernel) // 2
    weights = F.array(*[F.lit(float(k)) for k in kernel])
    at = lambda i, k: F.coalesce(F.try_element_at(values, (i + k - r).cast("int")), F.lit(0.0))
    steps = F.sequence(F.lit(0), F.lit(2 * r))

    def one(_, i):
        inside = lambda k: (i + 1 + k - r >= 1)
        return F.aggregate(steps, F.lit(0.0), lambda a, k: a + F.when(inside(k), at(i + 1, k) * weights[k]).otherwise(0.0))

    return F.transform(values, one)


def blur_image(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur of (height, width[, samples]) with zeros beyond the edges."""
    kernel = gaussian_kernel(sigma)
    out = np.asarray(image, dtype=np.float64)
    for axis in (0, 1):
        out = np.apply_along_axis(lambda v: np.convolve(v, kernel, mode="same") if len(v) >= len(kernel) else np.convolve(v, kernel)[len(kernel) // 2 : len(kernel) // 2 + len(v)], axis, out)
    return out


def region_mask(height: int, width: int, shapes: Sequence[Sequence[tuple[float, float]]], feather: float = 0.0) -> np.ndarray:
    """255 inside any shape (pixel centres on the grid), 0 outside; feathered edges are blurred."""
    y, x = np.mgrid[0:height, 0:width].astype(np.float64)
    mask = np.zeros((height, width), dtype=bool)
    for s in shapes:
        inside = np.zeros_like(mask)
        for (ax, ay), (bx, by) in zip(s, [*s[1:], s[0]]):
            if ay != by:
                inside ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
        mask |= inside
    out = mask.astype(np.float64) * 255
    return blur_image(out, feather) if feather else out


def censor(image: np.ndarray, mask: np.ndarray, effect: str, box: tuple[int, int, int, int] | None = None, sigma: float = 55.0) -> np.ndarray:
    """black, blur or crop of the masked part."""
    if effect == "crop":
        x1, y1, x2, y2 = box
        return image[y1:y2, x1:x2]
    a = (mask / 255.0)[..., None] if image.ndim == 3 else mask / 255.0
    other = np.zeros_like(image, dtype=np.float64) if effect == "black" else blur_image(image, sigma)
    return np.rint(image * (1 - a) + other * a).astype(image.dtype)


def detect(frames: DataFrame, detector: Callable[[pd.Series], pd.Series], pixels: str = "pixels") -> DataFrame:
    """Plug-in point: ``detector`` maps a series of frames to lists of (cls, conf, box); each detection becomes a row."""
    run = F.pandas_udf(detector, "array<struct<cls:string,conf:double,box:array<double>>>")
    found = frames.withColumn("__d", F.explode(run(F.col(pixels)))).drop(pixels)
    return found.select("*", "__d.cls", "__d.conf", "__d.box").drop("__d")


def letterbox(image: np.ndarray, size: int, fill: int = 114) -> np.ndarray:
    """Scale to fit a square (nearest pixel), pad evenly, RGB from BGR, 0..1."""
    h, w = image.shape[:2]
    r = size / max(h, w)
    nh, nw = max(1, round(h * r)), max(1, round(w * r))
    small = image[(np.arange(nh) / r).astype(int).clip(0, h - 1)][:, (np.arange(nw) / r).astype(int).clip(0, w - 1)]
    out = np.full((size, size, 3), fill, dtype=image.dtype)
    top, left = (size - nh) // 2, (size - nw) // 2
    out[top : top + nh, left : left + nw] = small
    return out[..., ::-1].astype(np.float32) / 255.0
