"""Parameters: typed records with defaults and checks, and the key = value configuration file."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from .amg import AmgParams
from .krylov import Control, StopTest

#: Fixed codes of the configuration file.
KRYLOV_CODES = {1: "cg", 2: "bicgstab", 3: "minres", 4: "gmres", 5: "vgmres", 6: "vfgmres", 7: "gcg", 8: "gcr"}
PRECONDITIONERS = {0: "none", 1: "diag", 2: "amg", 3: "fmg", 4: "ilu", 5: "schwarz"}
AMG_KINDS = {"c": "classical", "sa": "sa", "ua": "ua"}
CYCLES = {"v": "v", "w": "w", "a": "amli", "na": "kcycle", "vw": "vw", "wv": "wv"}
SMOOTHERS = {"jacobi": "jacobi", "gs": "gs", "sgs": "sgs", "sor": "sor", "ssor": "ssor", "gsor": "sor", "sgsor": "ssor", "poly": "poly", "l1diag": "l1"}
INTERPOLATIONS = {1: "direct", 2: "standard", 3: "energy", 4: "reduction", 6: "extended"}
COARSENINGS = {1: "rs", 2: "rsp", 4: "aggressive", 5: "mis"}


@dataclass(frozen=True)
class IluParams:
    kind: str = "k"  # k (level of fill), t (by size)
    fill: int = 0
    drop: float = 1e-3

    def __post_init__(self):
        if self.fill < 0 or self.drop < 0:
            raise ValueError("ILU fill and drop tolerance can't be negative")


@dataclass(frozen=True)
class SchwarzParams:
    depth: int = 2
    kind: str = "symmetric"  # forward, backward, symmetric


@dataclass(frozen=True)
class SolverParams:
    method: int = 1
    preconditioner: str = "amg"
    control: Control = field(default_factory=Control)
    amg: AmgParams = field(default_factory=AmgParams)
    ilu: IluParams = field(default_factory=IluParams)
    schwarz: SchwarzParams = field(default_factory=SchwarzParams)


def read_config(text: str) -> dict[str, str]:
    """key = value lines; % starts a comment; a key that is not known is an error."""
    out = {}
    for n, line in enumerate(text.splitlines(), 1):
        line = line.split("%")[0].strip()
        if not line:
            continue
        key, eq, value = line.partition("=")
        if not eq or not value.strip():
            raise ValueError(f"line {n}: expected key = value")
        out[key.strip()] = value.strip()
    return out


#: Configuration keys by where they go and how they are read.
_CONTROL = {"itsolver_tol": ("tol", float), "itsolver_abstol": ("abstol", float), "itsolver_maxit": ("maxit", int), "itsolver_restart": ("restart", int)}
_AMG = {
    "AMG_strong_coupled": ("coupled", float), "AMG_max_aggregation": ("max_aggregation", int), "AMG_tentative_smooth": ("tentative_smooth", float),
    "AMG_levels": ("max_levels", int), "AMG_tol": ("tol", float), "AMG_maxit": ("maxit", int), "AMG_coarse_dof": ("coarse_dof", int),
    "AMG_pair_number": ("pair_passes", int), "AMG_quality_bound": ("quality_bound", float), "AMG_presmooth_iter": ("pre", int),
    "AMG_postsmooth_iter": ("post", int), "AMG_relaxation": ("relaxation", float), "AMG_polynomial_degree": ("degree", int),
    "AMG_strong_threshold": ("theta", float), "AMG_truncation_threshold": ("truncation", float), "AMG_max_row_sum": ("max_row_sum", float),
    "AMG_amli_degree": ("amli_degree", int), "AMG_aggressive_level": ("aggressive_levels", int),
}
_OTHER = {
    "workdir", "problem_num", "print_level", "output_type", "solver_type", "stop_type", "decoup_type", "precond_type", "AMG_ILU_levels", "AMG_SWZ_levels",
    "AMG_type", "AMG_smooth_filter", "AMG_smooth_restriction", "AMG_coarse_solver", "AMG_coarse_scaling", "AMG_cycle_type", "AMG_smoother",
    "AMG_smooth_order", "AMG_coarsening_type", "AMG_interpolation_type", "AMG_aggregation_type", "AMG_aggregation_norm_type",
    "AMG_aggressive_path", "AMG_nl_amli_krylov_type", "ILU_type", "ILU_lfil", "ILU_droptol", "ILU_relax", "ILU_permtol", "SWZ_mmsize", "SWZ_maxlvl",
    "SWZ_type", "SWZ_blksolver",
}


def from_config(raw: dict[str, str]) -> SolverParams:
    known = _OTHER | set(_CONTROL) | set(_AMG)
    if unknown := set(raw) - known:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    control = Control(**{name: kind(float(raw[k])) if kind is int else kind(raw[k]) for k, (name, kind) in _CONTROL.items() if k in raw})
    if "stop_type" in raw:
        control.stop = StopTest(int(raw["stop_type"]))
    amg = {name: kind(float(raw[k])) if kind is int else kind(raw[k]) for k, (name, kind) in _AMG.items() if k in raw}
    lower = {k: v.lower() for k, v in raw.items()}
    for key, name, table in (("AMG_type", "kind", AMG_KINDS), ("AMG_cycle_type", "cycle", CYCLES), ("AMG_smoother", "smoother", SMOOTHERS)):
        if key in raw:
            amg[name] = table[lower[key]]
    for key, name, codes in (("AMG_interpolation_type", "interpolation", INTERPOLATIONS), ("AMG_coarsening_type", "coarsening", COARSENINGS)):
        if key in raw:
            amg[name] = codes[int(raw[key])]
    if "AMG_aggregation_type" in raw:
        amg["aggregation"] = "vmb" if int(raw["AMG_aggregation_type"]) in (2, 5) else "pairwise"
    if "AMG_coarse_scaling" in raw:
        amg["coarse_scaling"] = lower["AMG_coarse_scaling"] == "on"
    params = SolverParams(
        method=int(raw.get("solver_type", 1)),
        preconditioner=PRECONDITIONERS[int(raw.get("precond_type", 2))],
        control=control,
        amg=AmgParams(**amg),
        ilu=IluParams("k" if int(raw.get("ILU_type", 1)) == 1 else "t", int(raw.get("ILU_lfil", 0)), float(raw.get("ILU_droptol", 1e-3))),
        schwarz=SchwarzParams(int(raw.get("SWZ_maxlvl", 2)), {1: "forward", 2: "backward", 3: "symmetric"}[int(raw.get("SWZ_type", 3))]),
    )
    return checked(params)


def checked(p: SolverParams) -> SolverParams:
    """The parameters, or ValueError."""
    c, a = p.control, p.amg
    bad = [name for name, ok in (
        ("tol", 0 < c.tol < 1), ("maxit", c.maxit >= 0), ("restart", c.restart > 0), ("theta", 0 <= a.theta < 1), ("truncation", 0 <= a.truncation < 1),
        ("coupled", a.coupled >= 0), ("levels", a.max_levels > 0), ("sweeps", a.pre >= 0 and a.post >= 0), ("degree", a.degree >= 2 or a.smoother != "poly"),
    ) if not ok]
    if bad:
        raise ValueError(f"out of range: {', '.join(bad)}")
    return p


def load_config(path: str, overrides: dict[str, str] | None = None) -> SolverParams:
    """A configuration file with command-line overrides on top."""
    return from_config(read_config(Path(path).read_text()) | (overrides or {}))


def describe(record) -> dict:
    """All values of a parameter record, for logs."""
    return asdict(record)


def updated(record, **changes):
    names = {f.name for f in fields(record)}
    if unknown := set(changes) - names:
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    return replace(record, **changes)
