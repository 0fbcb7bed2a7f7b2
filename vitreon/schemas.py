"""Table schemas: every operator takes and returns DataFrames of these shapes, keyed by structure_id and frame."""

from __future__ import annotations

ATOMS = "structure_id string, frame int, atom_id bigint, atomic_number int, x double, y double, z double"
FRAMES = (
    "structure_id string, frame int, c00 double, c01 double, c02 double, c10 double, c11 double, c12 double, c20 double, c21 double, c22 double"
)
THERMO = (
    "run_id string, step bigint, temperature double, energy_tot double, volume double, pxx double, pyy double, pzz double, pxy double, "
    "pxz double, pyz double, lx double, ly double, lz double"
)
COMPOSITIONS = "comp_id string, pos int, oxide string, amount double"
JOBS = (
    "job_id string, version bigint, request_hash string, composition string, potential string, status string, request_data string, result_data string, "
    "elemental_vector array<double>, tags array<string>, created_at timestamp, completed_at timestamp"
)
#: What identifies one structure of one trajectory.
KEY = ["structure_id", "frame"]
CELL = [f"c{i}{j}" for i in range(3) for j in range(3)]
