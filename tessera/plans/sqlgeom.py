"""DuckDB expressions for the oracle, mirroring tessera.functions.geometry."""

from __future__ import annotations

MAX_RATIO = 200


def resize_sql(h: str, w: str, f, lo, hi, strict: bool = False) -> dict[str, str]:
    ratio = f"(CASE WHEN least({h}, {w}) = 0 THEN NULL ELSE greatest({h}, {w}) / least({h}, {w}) END)"
    rf = lambda x: f"CAST(round_even(({x}) / {f}, 0) * {f} AS BIGINT)"
    if strict:
        hb0, wb0 = rf(h), rf(w)
        reject = (f"CASE WHEN {h} < {f} OR {w} < {f} THEN 'side_below_factor' "
                  f"WHEN {ratio} IS NULL OR {ratio} > {MAX_RATIO} THEN 'aspect_ratio' END")
    else:
        hb0, wb0 = f"greatest({f}, {rf(h)})", f"greatest({f}, {rf(w)})"
        reject = f"CASE WHEN {ratio} IS NULL OR {ratio} > {MAX_RATIO} THEN 'aspect_ratio' END"
    area = f"(({hb0}) * ({wb0}))"
    b_hi = f"sqrt(({h} * {w}) / {hi})"
    b_lo = f"sqrt({lo} / ({h} * {w}))"

    def side(x, x0):
        return (f"(CASE WHEN {area} > {hi} THEN CAST(floor({x} / {b_hi} / {f}) * {f} AS BIGINT) "
                f"WHEN {area} < {lo} THEN CAST(ceil({x} * {b_lo} / {f}) * {f} AS BIGINT) ELSE {x0} END)")
    H, W = side(h, hb0), side(w, wb0)
    ok = f"(({reject}) IS NULL)"
    return {"height": f"CASE WHEN {ok} THEN {H} END", "width": f"CASE WHEN {ok} THEN {W} END",
            "reject": reject, "degenerate": f"({ok} AND ({H} = 0 OR {W} = 0))"}
