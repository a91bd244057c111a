"""Readers of scrape bodies, target groups and Kubernetes snapshots, and the writer of samples."""

from .files import read_exposition_bodies, read_k8s_objects, read_target_groups, write_samples
from ..shared import shared_folder, written

__all__ = ["read_exposition_bodies", "read_k8s_objects", "read_target_groups", "shared_folder", "write_samples", "written"]
