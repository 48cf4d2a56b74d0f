"""Periodic marker tokens on array columns.

All functions work on whole chunks of ``stride`` tokens (``slice`` copies)
instead of one lambda call per token.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def int_array(*values: int) -> Column:
    """Literal array of 32-bit token ids."""
    return F.array(*[F.lit(int(v)).cast("int") for v in values])


def check_equal_length(left: Column, right: Column, message: str) -> Column:
    """``left`` unchanged, or an error when the two arrays differ in length."""
    return F.when(F.size(left) == F.size(right), left).otherwise(
        F.raise_error(F.lit(message)).cast("array<int>"))


def marked_length(n: Column, stride: int) -> Column:
    """Length after marker insertion for a raw length column ``n``."""
    if stride <= 0:
        return n
    grown = n + F.floor((n - F.lit(1)) / F.lit(stride))
    return F.when(n > 0, grown).otherwise(F.lit(0)).cast("bigint")


def insert_markers(ids: Column, stride: int, marker_id: int) -> Column:
    """A marker after every ``stride`` ids, never after the last one.

    ``stride <= 0`` leaves the array as it is; empty stays empty.
    """
    if stride <= 0:
        return ids

    def marked(ids: Column) -> Column:
        size = F.size(ids)
        chunks = F.floor((size + F.lit(stride - 1)) / F.lit(stride)).cast("int")
        with_tail_marker = F.flatten(F.transform(
            F.sequence(F.lit(0), chunks - 1),
            lambda i: F.concat(F.slice(ids, i * stride + 1, F.lit(stride)), int_array(marker_id)),
        ))
        return F.when(size > stride, F.slice(with_tail_marker, F.lit(1), size + chunks - 1)).otherwise(ids)

    # as a lambda's variable: an expression for the ids would be made again for every chunk
    return F.get(F.transform(F.array(ids), marked), F.lit(0))


def insert_markers_with_labels(
    ids: Column, labels: Column, stride: int, marker_id: int, use_markers: bool = True
) -> tuple[Column, Column]:
    """Marker insertion on ids and labels together; a marker's label is 0."""
    message = "a label is needed for each id"
    ids = check_equal_length(ids, labels, message)
    if not use_markers:
        return ids, labels
    return insert_markers(ids, stride, marker_id), insert_markers(labels, stride, 0)


def tokens_since_last_marker(ids: Column, marker_id: int) -> Column:
    """Ids after the latest marker, the whole length when there is none."""
    from_end = F.array_position(F.reverse(ids), F.lit(marker_id).cast("int"))
    return F.when(from_end > 0, from_end - 1).otherwise(F.size(ids)).cast("int")


def maybe_append_marker(ids: Column, marker_id: int, stride: int) -> Column:
    """Close the sequence with a marker once ``stride`` ids have gone by without one."""
    due = tokens_since_last_marker(ids, marker_id) >= stride
    return F.when(due, F.concat(ids, int_array(marker_id))).otherwise(ids)


def wrap_document(ids: Column, stride: int, marker_id: int, bos_id: int, pad_id: int) -> Column:
    """bos, the marked document, pad."""
    return F.concat(int_array(bos_id), insert_markers(ids, stride, marker_id), int_array(pad_id))


def zero_one_labels(zeros: Column, ones: Column) -> Column:
    """Label vector with ``zeros`` times 0 followed by ``ones`` times 1."""
    return F.concat(F.array_repeat(F.lit(0), zeros), F.array_repeat(F.lit(1), ones))


def prompt_sequence(
    prompt: Column, choice: Column, *, stride: int, marker_id: int, bos_id: int, use_markers: bool = True
) -> tuple[Column, Column]:
    """bos + prompt + choice with labels (1 on the choice), markers inserted in both."""
    ids = F.concat(int_array(bos_id), prompt, choice)
    labels = zero_one_labels(F.size(prompt) + 1, F.size(choice))
    return insert_markers_with_labels(ids, labels, stride, marker_id, use_markers)


def mask_labels(ids: Column, *ignored: int, ignore_label: int = -100) -> Column:
    """Training labels as an array: ``ignore_label`` wherever the id is one of ``ignored``."""
    return F.transform(
        ids, lambda t: F.when(t.isin([int(i) for i in ignored]), F.lit(ignore_label)).otherwise(t))


def count_id(ids: Column, token_id: int) -> Column:
    """How often ``token_id`` occurs in the array."""
    return F.size(F.filter(ids, lambda t: t == token_id))
