"""Transaction kind, success and label as column expressions over the common gateway columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Codes, statuses and labels.
APPROVED_CODE = "10000"
REFUND_STATUSES = ("FULLY_REFUNDED", "PARTIALLY_REFUNDED")
VOID_STATUS = "CANCELED"
CANCEL_STATUS = "CANCEL"
APPROVED_STATUS = "APPROVED"
FAILED_STATUSES = ("DECLINED", "FAILED")

REFUND_OK, REFUND_BAD = "Refund Successful", "Refund Failed/Pending"
VOID_OK, VOID_BAD = "Void Successful", "Void Failed/Pending"
CAPTURE_ALONE_OK, CAPTURE_ALONE_BAD = "Capture Successful (auth_less)", "Capture Failed/Pending (auth_less)"
CAPTURE_MERGED_OK, CAPTURE_OK = "Capture Successful (Authorisation Merged)", "Capture Successful"
CAPTURE_BAD = "Capture Failed/Pending (Check Response: "
AUTH_OK, AUTH_BAD = "Authorisation Successful", "Authorisation Failed (Check Response: "
GENERAL_CODE_OK, GENERAL_STATUS_OK = "General Success (Code 10000)", "General Success (Approved)"
GENERAL_CODE_BAD, GENERAL_STATUS_BAD = "General Failure (Code: ", "General Failure (Declined/Failed)"
UNKNOWN = "Unknown/Incomplete Status"
SUCCESS, FAILURE = "Success", "Failure"


KIND, OK = "_kind", "_ok"


def kind() -> Column:
    """refund, void, capture, auth or other; the first that applies."""
    return (
        F.when(F.col("is_refund"), "refund")
        .when(F.col("is_void") | (F.upper("status") == CANCEL_STATUS), "void")
        .when(F.col("is_capture"), "capture")
        .when(F.col("is_auth"), "auth")
        .otherwise("other")
    )


def succeeded(partial_refunds: bool = True) -> Column:
    """True for a success, never NULL; reads the kind from the ``_kind`` column."""
    refunds = REFUND_STATUSES if partial_refunds else REFUND_STATUSES[:1]
    status, of_kind = F.upper("status"), F.col(KIND)
    by_status = (
        F.when(of_kind == "refund", status.isin(*refunds))
        .when(of_kind == "void", status == VOID_STATUS)
        .otherwise(status == APPROVED_STATUS)
    )
    return F.coalesce((F.col("response_code") == APPROVED_CODE) | by_status, F.lit(False))


def outcome() -> Column:
    return F.when(F.col(OK), SUCCESS).otherwise(FAILURE)


def label() -> Column:
    """Readable label from ``_kind`` and ``_ok``; the ones quoting the response code are NULL without a code."""
    ok, code, of_kind = F.col(OK), F.col("response_code"), F.col(KIND)
    alone, merged = F.col("has_auth_in_group") == 0, F.col("has_auth_in_group") == 1

    def quoting(text: str) -> Column:
        return F.concat(F.lit(text), code, F.lit(")"))

    capture = (
        F.when(alone & ok, CAPTURE_ALONE_OK).when(alone, CAPTURE_ALONE_BAD)
        .when(ok & merged, CAPTURE_MERGED_OK).when(ok, CAPTURE_OK)
        .otherwise(quoting(CAPTURE_BAD))
    )
    other = (
        F.when(code == APPROVED_CODE, GENERAL_CODE_OK)
        .when(ok, GENERAL_STATUS_OK)
        .when((code != APPROVED_CODE) & (code != ""), quoting(GENERAL_CODE_BAD))
        .when(F.upper("status").isin(*FAILED_STATUSES), GENERAL_STATUS_BAD)
        .otherwise(UNKNOWN)
    )
    return (
        F.when(of_kind == "refund", F.when(ok, REFUND_OK).otherwise(REFUND_BAD))
        .when(of_kind == "void", F.when(ok, VOID_OK).otherwise(VOID_BAD))
        .when(of_kind == "capture", capture)
        .when(of_kind == "auth", F.when(ok, AUTH_OK).otherwise(quoting(AUTH_BAD)))
        .otherwise(other)
    )


def response_category() -> Column:
    """approved, declined or none, for the simplified response codes."""
    code = F.col("response_code")
    return F.when(code == APPROVED_CODE, "approved").when(F.trim(code) != "", "declined").otherwise("none")
