"""Array arithmetic for images, latents and logits, as Column functions that stay inside the JVM.

Images are flat arrays; shapes are parameters.  A null array gives null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trainkit.functions.draws import normals

# Usual channel means and deviations of normalised image sets.
CIFAR_MEAN, CIFAR_STD = (0.4914, 0.4822, 0.4465), (0.2023, 0.1994, 0.2010)
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
HALF_MEAN, HALF_STD = (0.5,), (0.5,)


def doubles(arr: Column) -> Column:
    return arr.cast("array<double>")


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, fn) -> Column:
    """fn(value) with `value` computed once per row: inside a lambda, an expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _indices(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _pick(values: Sequence[float], c: Column) -> Column:
    """values[c]; a literal chain, so that it is folded for one channel."""
    if len(values) == 1:
        return F.lit(float(values[0]))
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (c + 1).cast("int"))


def to_unit_chw(arr: Column, h: int, w: int, c: int) -> Column:
    """Bytes in height, width, channel order -> channel, height, width in [0, 1]."""
    return F.when(
        arr.isNotNull(), F.transform(_indices(c * h * w), lambda i: F.get(arr, ((i % (h * w)) * c + F.floor(i / (h * w))).cast("int")) / F.lit(255.0))
    )


def normalize_channels(arr: Column, mean: Sequence[float], std: Sequence[float], pixels: int) -> Column:
    """(x - mean) / std by channel; `pixels` per channel."""
    return F.transform(arr, lambda x, i: (x - _pick(mean, F.floor(i / pixels))) / _pick(std, F.floor(i / pixels)))


def denormalize_to_uint8(arr: Column, mean: Sequence[float], std: Sequence[float], h: int, w: int) -> Column:
    """Channel, height, width -> bytes in height, width, channel order: x * std + mean, held in [0, 1], times 255, truncated."""
    c, area = len(mean), h * w
    return F.when(
        arr.isNotNull(),
        F.transform(
            _indices(c * area),
            lambda i: (
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get(arr, ((i % c) * area + F.floor(i / c)).cast("int")) * _pick(std, i % c) + _pick(mean, i % c))) * 255.0
            ).cast("int"),
        ),
    )


def minmax_rows(arr: Column) -> Column:
    """(x - min) / (max - min) per array; null elements when the array is constant."""
    ends = F.struct(arr.alias("arr"), F.array_min(arr).alias("low"), F.array_max(arr).alias("high"))
    return bound(ends, lambda s: F.transform(s["arr"], lambda x: F.when(s["high"] > s["low"], (x - s["low"]) / (s["high"] - s["low"]))))


def spatial_vectors(arr: Column, c: int, h: int, w: int, layout: str = "channels_last") -> Column:
    """One c-vector per position. channels_last: position p has arr[k*h*w + p]; memory: consecutive runs of c values."""
    area = h * w
    if layout == "memory":
        return F.transform(_indices(area), lambda p: F.slice(arr, (p * c + 1).cast("int"), F.lit(c)))
    if layout != "channels_last":
        raise ValueError(f"unknown layout {layout}")
    return F.transform(_indices(area), lambda p: F.transform(_indices(c), lambda k: F.get(arr, (k * area + p).cast("int"))))


def reshape_rows(arr: Column) -> Column:
    """Nested rows -> one flat array."""
    return F.flatten(arr)


def argmax(arr: Column) -> Column:
    """The lowest index of the largest element."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def raised(logits: Column) -> Column:
    """e^(x - max) of every element."""
    return bound(F.struct(logits.alias("arr"), F.array_max(logits).alias("high")), lambda s: F.transform(s["arr"], lambda x: F.exp(x - s["high"])))


def softmax(logits: Column) -> Column:
    """In time proportional to the number of elements; null for a null array."""
    summed = lambda r: bound(F.struct(r.alias("arr"), total(r).alias("sum")), lambda s: F.transform(s["arr"], lambda x: x / s["sum"]))
    return bound(raised(logits), summed)


def max_softmax(logits: Column) -> Column:
    """The largest softmax value."""
    return F.lit(1.0) / total(raised(logits))


def rank_of(logits: Column, label: Column) -> Column:
    """1 + the number of classes ahead of `label`: larger logits, or equal ones of lower index."""
    own = F.get(logits, label.cast("int"))
    both = F.struct(logits.alias("arr"), own.alias("own"), label.alias("label"))
    ahead = bound(both, lambda s: F.size(F.filter(s["arr"], lambda x, i: (x > s["own"]) | ((x == s["own"]) & (i < s["label"])))))
    return F.when(own.isNotNull(), ahead + 1)


def topk_classes(logits: Column, k: int) -> Column:
    """The k largest logits as (class, logit), largest first; equal ones by class."""
    pairs = F.transform(logits, lambda x, i: F.struct((-x).alias("order"), i.alias("class")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["class"].alias("class"), (-s["order"]).alias("logit")))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def square_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(arr: Column) -> Column:
    return F.sqrt(F.aggregate(arr, F.lit(0.0), lambda s, x: s + x * x))


def lerp(a: Column, b: Column, alpha: Column | float) -> Column:
    """alpha * a + (1 - alpha) * b."""
    t = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.zip_with(a, b, lambda x, y: t * x + (F.lit(1.0) - t) * y)


def clip_array(arr: Column, low: float, high: float) -> Column:
    return F.transform(arr, lambda x: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def one_hot(code: Column, k: int) -> Column:
    return F.when(code.isNotNull(), F.transform(_indices(k), lambda i: (i == code).cast("int")))


def reparameterize(mu: Column, logvar: Column, eps: Column | None = None, seed: int = 0, key: Column | None = None) -> Column:
    """mu + e^(logvar / 2) * eps, where eps is given, or drawn from the seed, the row's key and the element's place.

    Null where mu, logvar or the key is null; elements beyond the shorter array are null.
    """
    if eps is None:
        if key is None:
            raise ValueError("eps or a key to draw it from")
        eps = normals(F.size(mu), seed, key)
    scaled = F.zip_with(logvar, eps, lambda v, e: F.exp(v * 0.5) * e)
    return F.zip_with(mu, scaled, lambda m, s: m + s)


def scalar_quantize(x: Column, codes: Sequence[float]) -> Column:
    """The nearest of a short list of values; the first one on ties."""
    nearest = F.array_min(F.array(*[F.struct(((x - c) * (x - c)).alias("d"), F.lit(i).alias("i"), F.lit(float(c)).alias("c")) for i, c in enumerate(codes)]))
    return F.when(x.isNotNull(), nearest["c"])


def heat_color(x: Column, capped: bool = True) -> Column:
    """Red, green and blue of a heat value: bumps per channel, at most 1 where capped."""
    # Fixed values: (height, centre, width) of the bumps.
    channels = {"r": [(0.5, 0.6, 0.2), (1.0, 0.8, 0.3)], "g": [(1.0, 0.5, 0.3)], "b": [(1.0, 0.2, 0.3)]}
    out = []
    for name, bumps in channels.items():
        value = sum((F.exp(-(x - c) * (x - c) / (2 * s * s)) * a for a, c, s in bumps), F.lit(0.0))
        out.append((F.least(F.lit(1.0), value) if capped else value).alias(name))
    return F.struct(*out)


def coordinate(position: Column, h: int, w: int) -> Column:
    """(row, column) of a flat position, each from 0 to 1."""
    return F.struct((F.floor(position / w) / float(max(1, h - 1))).alias("row"), ((position % w) / float(max(1, w - 1))).alias("col"))


def geometric_moment(arr: Column, h: int, w: int, p: int, q: int, affine: Column | None = None) -> Column:
    """Mean over pixels of x^p * y^q * pixel, x and y from 0 to 1, moved by the six numbers of `affine` if given."""
    area = h * w

    def basis(v: Column, i: Column) -> Column:
        x, y = (i % w) / float(max(1, w - 1)), F.floor(i / w) / float(max(1, h - 1))
        if affine is not None:
            a = [F.get(affine, k) for k in range(6)]
            x, y = a[0] * x + a[1] * y + a[2], a[3] * x + a[4] * y + a[5]
        weight = F.lit(1.0)
        for factor, power in ((x, p), (y, q)):
            for _ in range(power):
                weight = weight * factor
        return v * weight

    return total(F.transform(arr, basis)) / float(area)


def channel_stat(arr: Column, channel: int, pixels: int) -> tuple[Column, Column]:
    """(mean, sample deviation) of one channel of one image, without exploding it."""
    part = F.slice(arr, channel * pixels + 1, pixels)
    mean = total(part) / float(pixels)
    both = F.struct(part.alias("part"), mean.alias("mean"))
    spread = bound(both, lambda b: F.aggregate(b["part"], F.lit(0.0), lambda s, x: s + (x - b["mean"]) * (x - b["mean"])))
    return mean, F.sqrt(spread / float(max(1, pixels - 1)))


def pretty_class(name: Column) -> Column:
    return F.initcap(F.translate(name, "_", " "))
