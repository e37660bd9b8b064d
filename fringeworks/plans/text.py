"""Reports as lines of text."""

from __future__ import annotations

from ..sources.model import VisibilitySet
from . import reports


def summary(vs: VisibilitySet, name: str, offset: float = reports.DEFAULT_OFFSET) -> str:
    t = reports.flag_totals(vs).first()
    out = [f"Flags of {name}", f"  cells: {t.n_flagged} of {t.n_total} ({t.percent:.2f} %)", f"  rows: {t.rows_flagged} of {t.rows_total} ({t.rows_percent:.2f} %)"]
    uv = reports.uv_percentiles(vs).orderBy("percentile").collect()
    if uv and uv[-1].uv is not None:
        out += [f"  largest UV distance: {uv[-1].uv:.2f} m", "  UV distance by percentile:", *(f"    {r.percentile:g}: {r.uv:.2f} m" for r in uv)]
    out.append("  rows by share of unflagged cells:")
    for r in reports.unflagged_histogram(vs).orderBy("bin").collect():
        share = 100 * r.rows / t.rows_total if t.rows_total else 0.0
        out.append(f"    {reports.BINS[r.bin]:>6}: {r.rows:8d} ({share:5.1f} %) {'#' * max(1, int(share / 2))}")
    e, s = reports.row_extremes(vs).first(), reports.row_sizes(vs).first()
    out.append(f"  cells in a row: {s.max_size}, unflagged {e.min_unflagged} to {e.max_unflagged}, flagged {e.min_flagged} to {e.max_flagged}")
    out.append(f"  row sizes: {'all alike' if s.consistent else f'from {s.min_size} to {s.max_size}'}")
    c = reports.spectral(vs).first()
    if c.nchan:
        out.append(f"  spectral windows: {c.nspw}, channels: {c.nchan}, {c.fmin_mhz:.3f} to {c.fmax_mhz:.3f} MHz, bandwidth {c.bandwidth_mhz:.1f} MHz")
        out.append(f"  longest integration at {offset:.4g} rad from the phase centre:")
        out += [f"    {r.loss:.0%} loss: {r.dt_max:.1f} s" for r in reports.longest_integrations(vs, offset).orderBy("loss").collect()]
        if (dt := reports.current_integration(vs).first().dt) is not None:
            out.append(f"  present integration: {dt:.1f} s")
    out += ["  fields:", *(f"    {r.field_id}: {r.name} {r.rows} rows" for r in reports.fields(vs).orderBy("field_id").collect())]
    return "\n".join(out)


def strongest(vs: VisibilitySet, corr: int | None = None) -> str:
    m, s = reports.strongest(vs, corr).first(), reports.amplitude_statistics(vs).first()
    if m is None or m.max_amplitude is None:
        return "No visibilities"
    names = [n for n in s.asDict() if n != "mean_amplitude"]
    return "\n".join([
        f"Max |v| = {m.max_amplitude:g} in ({vs.nchan}, {vs.ncorr}) cells a row",
        f"  row {m.row_id}, channel {m.chan}, correlation {m['corr']}",
        f"  flag {m.flag}, weight {m.weight}, time {m.timestamp} UTC, antennas {m.antenna1} and {m.antenna2}",
        f"  mean |v| = {s.mean_amplitude:g}",
        *(f"  percentile {p:g}: {s[n]:.2f}" for p, n in zip(reports.AMPLITUDE_PERCENTILES, names)),
    ])
