"""Names and places of sequences, lineage files, checkpoints and results. Listings come from the caller, so that they
may be of any store."""

from __future__ import annotations

import re

#: File endings of image stacks, in order of preference, and names of lineage files likewise.
SUFFIXES = (".tif", ".tiff", ".nd2", ".dv", ".czi", ".lif")
LINEAGE_NAMES = ("states.txt", "res_track.txt", "man_track.txt")


def sequences(names: list[str], layout: str, segmentation: str = "masks", folders: dict[str, list[str]] | None = None) -> list[str]:
    """Sequence ids among the names in a data folder (for ctc: of its folders). S1.

    ctc: folders that are the text before the first _ of some folder (their own name counts); flat: files that end in
    _segmentation and a known suffix; dirs: folders that hold something named segmentation."""
    if layout == "ctc":
        return sorted({n.split("_")[0] for n in names} & set(names))
    if layout == "flat":
        ends = [f"_{segmentation}{s}" for s in SUFFIXES]
        return sorted({n[: -len(e)] for n in names for e in ends if n.endswith(e)})
    if layout == "dirs":
        return sorted(f for f, inside in (folders or {}).items() if any(x == segmentation or x.rsplit(".", 1)[0] == segmentation for x in inside))
    raise ValueError(f"unknown layout {layout!r}")


def mask_folder(names: list[str], sequence: str, kind: str | None = None) -> str:
    """Where a sequence's masks are: what is asked for, else TRA, else SEG, else the sequence's own folder. S3."""
    for k in [kind] if kind else ["TRA", "SEG"]:
        for name in (f"{sequence}_GT/{k}", f"{sequence}_ST/{k}", f"{sequence}_{k}"):
            if name in names:
                return name
    return sequence


def find_lineage(names: list[str], start: str, data_dir: str = "") -> str | None:
    """The file of states nearest to a folder, searching outward as far as data_dir; only without any, the nearest file
    of tracks, in one folder by the order of LINEAGE_NAMES. S7."""
    folders, last = [start.rstrip("/")], data_dir.rstrip("/")
    while folders[-1] and folders[-1] != last:
        folders.append(folders[-1].rpartition("/")[0])
    for kinds in (LINEAGE_NAMES[:1], LINEAGE_NAMES[1:]):
        for folder in folders:
            for name in kinds:
                path = f"{folder}/{name}" if folder else name
                if path in names:
                    return path
    return None


def choose_checkpoint(names: list[str]) -> str | None:
    """best, else last, else the highest epoch named, else the best metric named. S18."""
    stem = {n.rsplit("/", 1)[-1].rsplit(".", 1)[0]: n for n in names}
    for wanted in ("best", "last"):
        if wanted in stem:
            return stem[wanted]
    for rule in (r"last[_-]epoch[=_-]?(\d+)", r"epoch[=_-]?(\d+)", r"[a-z_]+[=_-](\d+\.\d+)"):
        ranked = sorted((float(m[1]), n) for s, n in stem.items() if (m := re.search(rule, s)))
        if ranked:
            return ranked[-1][1]
    return None


def result_suffix(layout: str, given: str | None = None) -> str:
    """What result names end in. K11."""
    return given if given is not None else {"ctc": "_RES", "flat": "_tracks"}[layout]


def shared_id(images: str, masks: str) -> str | None:
    """The common beginning of two file names without _, -, . and space at its end, if longer than one character; else
    none. K11."""
    a, b = (n.rsplit("/", 1)[-1].rsplit(".", 1)[0] for n in (images, masks))
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    common = a[:k].rstrip("_-. ")
    return common if len(common) > 1 else None


def results_exist(names: list[str], sequence: str, layout: str, suffix: str | None = None) -> bool:
    """flat needs both files, ctc a folder with something in it. K15."""
    name = f"{sequence}{result_suffix(layout, suffix)}"
    if layout == "flat":
        return f"{name}.csv" in names and f"{name}.tif" in names
    return any(n.startswith(f"{name}/") for n in names)


def spacing(given: dict[str, float] | list[float] | None) -> dict[str, float]:
    """t, z, y, x as a mapping; missing ones are 1. F39."""
    axes = ("t", "z", "y", "x")
    if given is None:
        return dict.fromkeys(axes, 1.0)
    if isinstance(given, dict):
        if unknown := set(given) - set(axes):
            raise ValueError(f"unknown axes {sorted(unknown)}")
        return {k: float(given.get(k, 1.0)) for k in axes}
    if len(given) != 4:
        raise ValueError("spacing has four numbers: t, z, y, x")
    return dict(zip(axes, map(float, given), strict=True))
