"""Per-pixel expressions: colour, temperature, depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Atmosphere model of the thermal camera.
ATA1, ATA2 = 0.006569, 0.01262
ATB1, ATB2 = -0.002276, -0.00667
ATX = 1.9
KELVIN = 273.15

# Linear fix of low-gain thermal frames and the count that marks them.
LOW_GAIN_BELOW = 7500
LOW_GAIN_SCALE, LOW_GAIN_SHIFT = 3.356422717437227, -1404.6130301150079

# Stereo baseline in metres; guard against a zero disparity.
BASELINE_M = 0.075
DISPARITY_EPS = 1e-8

# Leaf thresholds for hue, saturation and value on a 0-255 scale.
LEAF_HUE, LEAF_SATURATION, LEAF_VALUE = 40, 15, 15

# Fixed value: vertical offset of the thermal window in the visible frame.
IR_OFFSET_Y = 32


def centikelvin_to_c(raw: Column) -> Column:
    """Thermal band value to degrees Celsius."""
    return raw / 100 - KELVIN


def swap_bytes(raw: Column) -> Column:
    """Exchange the two bytes of a 16-bit count."""
    return F.shiftright(raw, 8) + F.shiftleft(raw.bitwiseAND(F.lit(0xFF)), 8)


def low_gain_fix(raw: Column, image_max: Column) -> Column:
    """Rescale counts of frames whose largest count marks them as low gain."""
    return F.when(image_max < LOW_GAIN_BELOW, raw * LOW_GAIN_SCALE + LOW_GAIN_SHIFT).otherwise(
        raw.cast("double"))


def raw_to_celsius(
    raw: Column, emissivity: Column, distance: Column, reflected: Column, atmosphere: Column,
    window: Column, transmission: Column, humidity: Column, r1: Column, b: Column, f: Column,
    o: Column, r2: Column,
) -> Column:
    """Sensor count to degrees Celsius: Planck curve behind air and a window."""
    water = humidity / 100 * F.exp(
        1.5587 + 0.06939 * atmosphere - 0.00027816 * F.pow(atmosphere, F.lit(2))
        + 0.00000068455 * F.pow(atmosphere, F.lit(3)))
    root = F.sqrt(distance / 2)
    tau = ATX * F.exp(-root * (ATA1 + ATB1 * F.sqrt(water))) + (1 - ATX) * F.exp(
        -root * (ATA2 + ATB2 * F.sqrt(water)))
    radiance = lambda t: r1 / (r2 * (F.exp(b / (t + KELVIN)) - f)) - o
    air = radiance(atmosphere)
    seen = (
        raw / emissivity / tau / transmission / tau
        - (1 - tau) / emissivity / tau * air
        - (1 - tau) / emissivity / tau / transmission / tau * air
        - (1 - transmission) / emissivity / tau / transmission * radiance(window)
        - (1 - emissivity) / emissivity * radiance(reflected)
    )
    return b / F.ln(r1 / (r2 * (seen + o)) + f) - KELVIN


def excess_green(r: Column, g: Column, b: Column) -> Column:
    """2g - r - b of the channel shares; black pixels give 0."""
    total = (r + g + b).cast("double")
    return F.coalesce(F.try_divide(2 * g - r - b, total), F.lit(0.0))


def to_byte(value: Column, low: Column, high: Column) -> Column:
    """Stretch [low, high] to 0..255, halves to even; a flat range gives 0."""
    scaled = F.bround((value - low) * (F.lit(255.0) / F.nullif(high - low, F.lit(0.0))), 0)
    return F.coalesce(scaled, F.lit(0.0)).cast("int")


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """``struct<h, s, v>`` in 0..1 from 0..255 channels."""
    top, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    span = F.nullif(top - low, F.lit(0.0))
    sixth = F.when(b == top, 4 + (r - g) / span).when(g == top, 2 + (b - r) / span).otherwise(
        (g - b) / span)
    return F.struct(
        F.coalesce(F.pmod(sixth / 6, F.lit(1.0)), F.lit(0.0)).alias("h"),
        F.coalesce(F.try_divide(top - low, top), F.lit(0.0)).alias("s"),
        (top / 255).alias("v"))


def hsv_leaf_mask(r: Column, g: Column, b: Column) -> Column:
    """True for leaf-coloured pixels."""
    hsv = rgb_to_hsv(r, g, b)
    byte = lambda name: (hsv[name] * 255.0).cast("int")
    return (byte("h") > LEAF_HUE) & (byte("s") > LEAF_SATURATION) & (byte("v") > LEAF_VALUE)


def disparity_to_xyz(
    col: Column, row: Column, disparity: Column, fx: Column, fy: Column, cx: Column, cy: Column
) -> Column:
    """Camera-frame ``struct<x, y, z>`` metres of a pixel with a disparity."""
    z = BASELINE_M * fx / (disparity + DISPARITY_EPS)
    return F.struct(((col - cx) * z / fx).alias("x"), ((row - cy) * z / fy).alias("y"), z.alias("z"))


def orient_cloud(
    heading: Column, row: Column, col: Column, height: Column, width: Column,
    x: Column, y: Column, z: Column, east_cm: Column, north_cm: Column,
) -> Column:
    """Turn a stereo cloud to the driving direction and move it to UTM centimetres.

    East and West frames turn a quarter; North frames turn half way round, which
    also restores the sign of x.  ``struct<row, col, x, y, z>``.
    """
    new_row = F.when(heading == "North", height - 1 - row).when(heading == "East", col).when(
        heading == "West", width - 1 - col).otherwise(row)
    new_col = F.when(heading == "North", width - 1 - col).when(
        heading == "East", height - 1 - row).when(heading == "West", row).otherwise(col)
    signed = F.when(heading == "North", x).otherwise(-x)
    return F.struct(new_row.alias("row"), new_col.alias("col"), (signed + east_cm).alias("x"),
                    (y + north_cm).alias("y"), z.alias("z"))


def ir_crop_window(
    rgb_width: Column, rgb_height: Column, real2ir: Column, offset_x: Column, offset_y: Column,
    image_width: Column, image_height: Column,
) -> Column:
    """Window of the visible frame seen by the thermal sensor.

    Landscape frames are turned to portrait first, which exchanges the visible
    size and the lens offsets.  ``struct<x1, y1, x2, y2>``.
    """
    turned = image_width > image_height
    w = F.when(turned, rgb_height).otherwise(rgb_width)
    h = F.when(turned, rgb_width).otherwise(rgb_height)
    shift = F.when(turned, offset_y).otherwise(offset_x).cast("int")
    edge = lambda size, side: (size / 2 + side * (size / real2ir) / 2).cast("int")
    return F.struct(
        (edge(w, -1) + shift).alias("x1"), (edge(h, -1) + IR_OFFSET_Y).alias("y1"),
        (edge(w, 1) + shift).alias("x2"), (edge(h, 1) + IR_OFFSET_Y).alias("y2"))
