"""Command line: extract, inspect, symbols.  A path may be a file, a folder or a glob."""

from __future__ import annotations

import argparse
import glob
import os
import sys

from plinth import __version__
from plinth.functions.words import parse_scale

OK, FAILED, WRONG = 0, 1, 2


def table_text(head: list[str], rows: list[list]) -> str:
    cells = [[("" if v is None else str(v)) for v in r] for r in [head, *rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(head))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def _exists(path: str) -> bool:
    return "://" in path or os.path.exists(path) or bool(glob.glob(path))


def _origin(text: str | None) -> tuple[float, float] | None:
    if not text:
        return None
    lat, lon = (float(v) for v in text.split(","))
    return lat, lon


def report(model) -> str:
    s = model["scale"]
    out = [f"{model['plan_id']}: 1:{s['drawing_scale']:.0f} from {s['source']} ({s['confidence']:.2f}), {len(model['walls'])} walls, {len(model['openings'])} openings"]
    out.append(table_text(["room", "name", "category", "gross m2", "net m2", "label m2", "check"], [[r["id"], r["name"], r["category"], f"{r['area_gross_m2']:.2f}", f"{r['area_net_m2']:.2f}", r["labelled_area_m2"], r["area_check"]] for r in model["rooms"]]))
    out.append(table_text(["opening", "kind", "symbol", "width mm", "confidence"], [[o["id"], o["kind"], o["symbol"], o["width_mm"], o["confidence"]] for o in model["openings"]]))
    out.append(table_text(["from", "to", "kind", "via"], [[e["a"], e["b"], e["kind"], e["via"]] for e in model["edges"]]))
    if seen := [[f["room"] or "plan", f["symbol"], f["confidence"], f["meta"]] for f in [*model["features"], *model["plan_features"]]]:
        out.append(table_text(["where", "symbol", "confidence", "details"], seen))
    return "\n\n".join(out + [f"warning: {w}" for w in model["warnings"]])


def cmd_extract(a, spark=None) -> int:
    from plinth.plans.extract import extract
    from plinth.session import session
    from plinth.sinks.writer import FORMATS, outputs, save
    from plinth.sources.reader import read_drawings

    formats = [f.strip() for f in a.formats.split(",") if f.strip()]
    try:
        origin = _origin(a.geo_origin)
    except ValueError:
        print("a geo origin is LAT,LON", file=sys.stderr)
        return WRONG
    if not formats or set(formats) - set(FORMATS) or not _exists(a.plan):
        print(f"no such plan or format: {a.plan}, {a.formats}", file=sys.stderr)
        return WRONG
    pages = read_drawings(spark or session(), a.plan, a.page).persist()
    bad = pages.where("error is not null").select("plan_id", "error").limit(20).collect()
    models = extract(pages.where("error is null"), a.scale, a.min_room_area).persist()
    save(outputs(models, formats, origin), a.output)
    said = models.where("size(warnings) > 0").limit(1).count()
    if not a.quiet:
        for row in models.limit(20).collect():
            print(report(row), end="\n\n")
    for r in bad:
        print(f"{r['plan_id']}: {r['error']}", file=sys.stderr)
    return FAILED if bad or (a.strict and said) else OK


def cmd_inspect(a, spark=None) -> int:
    from plinth.plans.scale import from_dimensions, from_doors, from_title
    from plinth.session import session
    from plinth.sources.reader import layer_histogram, primitives_of, read_drawings

    if not _exists(a.plan):
        print(f"no such plan: {a.plan}", file=sys.stderr)
        return WRONG
    pages = read_drawings(spark or session(), a.plan, a.page).limit(1).persist()
    page = pages.first()
    if page is None or page["error"]:
        print(page["error"] if page else "no drawing", file=sys.stderr)
        return FAILED
    print(f"{page['plan_id']}: box {tuple(page['box'])}, {len(page['primitives'])} primitives, {len(page['texts'])} texts")
    layers = layer_histogram(primitives_of(pages)).orderBy("n", ascending=False).collect()
    print(table_text(["layer", "primitives"], [[r["layer"] or "(none)", r["n"]] for r in layers]))
    shapes = [{"points": [complex(p["x"], p["y"]) for p in r["points"]], "closed": r["closed"]} for r in page["primitives"]]
    segs = [(p, q) for s in shapes for p, q in zip(s["points"], s["points"][1:], strict=False)]
    texts = [t.asDict() for t in page["texts"]]
    for name, found in (("dimension", from_dimensions(segs, texts)), ("titleblock", from_title(texts)), ("door", from_doors(shapes))):
        print(f"scale from {name}: " + (f"1:{found.ratio:.1f} ({found.confidence:.2f}, {found.detail})" if found else "nothing"))
    for t in texts[: a.text]:
        print(f"  {t['text']!r} at {t['x']:.1f}, {t['y']:.1f}")
    return OK


def cmd_symbols(a, spark=None) -> int:
    from plinth.symbols import registry

    found = sorted(registry().values(), key=lambda s: (s.scope, -s.priority, s.id))
    print(table_text(["symbol", "scope", "kind", "priority", "description"], [[s.id, s.scope, s.kind, s.priority, s.description] for s in found]))
    return OK


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plinth", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="models and files of drawings")
    e.add_argument("plan")
    e.add_argument("-o", "--output", default=".")
    e.add_argument("-p", "--page", type=int, default=0)
    e.add_argument("-s", "--scale", help="1:50, 1/50, 50 or 17.64mm")
    e.add_argument("-f", "--formats", default="json")
    e.add_argument("--geo-origin", help="LAT,LON")
    e.add_argument("--min-room-area", type=float, default=0.7)
    e.add_argument("--strict", action="store_true")
    e.add_argument("-q", "--quiet", action="store_true")
    i = sub.add_parser("inspect", help="layers, texts and scales of a page")
    i.add_argument("plan")
    i.add_argument("-p", "--page", type=int, default=0)
    i.add_argument("--text", type=int, default=0, metavar="N")
    sub.add_parser("symbols", help="the symbol library")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = build_parser().parse_args(argv)
    if getattr(a, "scale", None) and parse_scale(a.scale) is None:
        print(f"scale {a.scale!r} can't be read; looking for one on the sheet", file=sys.stderr)
    return {"extract": cmd_extract, "inspect": cmd_inspect, "symbols": cmd_symbols}[a.command](a, spark)


if __name__ == "__main__":
    sys.exit(main())
