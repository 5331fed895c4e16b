"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinshelf.functions.fixed_values import (
    EXCLUDED_DIRECTORIES,
    FORBIDDEN_IN_FOLDER_NAME,
    SUPPORTED_EXTENSIONS,
    TEXT_EXTENSIONS,
)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_folder(path: Column) -> Column:
    """Everything before the last slash; "" for a path at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def child_path(folder: Column, name: Column) -> Column:
    """``folder/name``, where "." and "" both mean the root."""
    return F.when(folder.isin("", "."), name).otherwise(F.concat_ws("/", folder, name))


def name_stem(name: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)\.([^.]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(SUPPORTED_EXTENSIONS)


def file_type(path: Column) -> Column:
    return F.when(extension(path).isin(TEXT_EXTENSIONS), "text").otherwise("pdf")


def has_hidden_part(relative_path: Column) -> Column:
    return F.concat(F.lit("/"), relative_path).contains("/.")


def is_excluded(relative_path: Column) -> Column:
    """A hidden part or a build directory anywhere in the path."""
    return has_hidden_part(relative_path) | F.arrays_overlap(
        F.split(relative_path, "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRECTORIES])
    )


def clean_folder_name(name: Column) -> Column:
    """One path segment that any file system accepts."""
    bare = F.regexp_replace(name, FORBIDDEN_IN_FOLDER_NAME, "")
    bare = F.regexp_replace(bare, r"^[. ]+|[. ]+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", "Uncategorized").otherwise(bare)


def clean_folder_path(path: Column) -> Column:
    """``clean_folder_name`` on every segment, keeping the nesting."""
    return F.array_join(F.transform(F.split(path, "/"), clean_folder_name), "/")
