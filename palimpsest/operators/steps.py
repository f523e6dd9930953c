"""Roles of elements, types of pages, and what becomes of a step: valid states, causes of failure, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles by element type, where the type alone decides.
ROLE_OF_TYPE = {
    "input:submit": "submit_button", "input:checkbox": "checkbox", "input:radio": "radio_button", "input:file": "file_upload", "input:hidden": "hidden_field",
    "select": "dropdown", "role:tab": "tab_control", "role:menuitem": "menu_item", "role:checkbox": "checkbox", "role:radio": "radio_button", "role:combobox": "combobox",
    "role:switch": "toggle", "role:option": "list_option", "role:link": "content_link",
}
# States that may follow each state.
NEXT_STATES = {
    "IDLE": ["OBSERVING", "PLANNING", "TASK_RECEIVED", "FAILED"],
    "OBSERVING": ["UNDERSTANDING", "PLANNING", "REPLANNING", "FAILED", "BLOCKED", "STOPPED"],
    "UNDERSTANDING": ["PLANNING", "WAITING_FOR_USER", "WAITING_FOR_CONFIRMATION", "COMPLETED", "OBSERVING", "REPLANNING", "FAILED", "STOPPED"],
    "PLANNING": ["WAITING_FOR_REASONER", "VALIDATING_ACTION", "EXECUTING_ACTION", "WAITING_FOR_USER", "WAITING_FOR_CONFIRMATION", "COMPLETED", "REPLANNING", "OBSERVING", "FAILED", "STOPPED"],
    "WAITING_FOR_REASONER": ["VALIDATING_ACTION", "REPLANNING", "OBSERVING", "FAILED", "STOPPED"],
    "VALIDATING_ACTION": ["EXECUTING_ACTION", "WAITING_FOR_USER", "WAITING_FOR_CONFIRMATION", "REPLANNING", "COMPLETED", "OBSERVING", "FAILED", "STOPPED"],
    "EXECUTING_ACTION": ["VERIFYING_ACTION", "OBSERVING", "REPLANNING", "FAILED", "STOPPED"],
    "VERIFYING_ACTION": ["OBSERVING", "UNDERSTANDING", "PLANNING", "REPLANNING", "COMPLETED", "FAILED", "STOPPED"],
    "WAITING_FOR_USER": ["OBSERVING", "UNDERSTANDING", "PLANNING", "EXECUTING_ACTION", "STOPPED", "FAILED"],
    "WAITING_FOR_CONFIRMATION": ["EXECUTING_ACTION", "STOPPED", "COMPLETED", "OBSERVING", "FAILED"],
    "REPLANNING": ["OBSERVING", "PLANNING", "WAITING_FOR_REASONER", "WAITING_FOR_USER", "FAILED", "BLOCKED", "STOPPED"],
    "COMPLETED": ["IDLE", "OBSERVING", "PLANNING", "TASK_RECEIVED"],
    "BLOCKED": ["IDLE", "OBSERVING", "PLANNING", "REPLANNING", "FAILED"],
    "FAILED": ["IDLE", "OBSERVING", "PLANNING", "TASK_RECEIVED"],
    "STOPPED": ["IDLE", "OBSERVING", "PLANNING", "TASK_RECEIVED"],
}
# How each cause of failure is met.
STRATEGY = {
    "INTENDED_CHANGE_ALREADY_DONE": "SKIP", "MODAL_OVERLAY": "RESOLVE_MODAL", "COOKIE_BANNER": "ACCEPT_COOKIES", "LOGIN_REQUIRED": "WAIT_FOR_USER", "VALIDATION_ERROR": "REPLAN_DIFFERENT_ACTION",
    "PAGE_LOADING": "WAIT_ONCE", "TARGET_DISAPPEARED": "REPLAN_FRESH_DOM", "DISABLED_ELEMENT": "REPLAN_DIFFERENT_ACTION", "NO_EFFECT": "REPLAN_DIFFERENT_ACTION",
}
FORM_ROLES = ["form_field", "dropdown", "checkbox", "radio_button"]


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def role(kind: Column, is_search: Column, in_form: Column, is_pagination: Column, in_nav: Column) -> Column:
    """The semantic role of an element; null flags count as false."""
    kind = F.lower(F.coalesce(kind, F.lit("")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    button, field = kind.isin("button", "role:button"), kind.startswith("input:") | (kind == "textarea")
    return (
        F.when(lookup(kind, ROLE_OF_TYPE).isNotNull(), lookup(kind, ROLE_OF_TYPE))
        .when(field, F.when(yes(is_search), "search_input").otherwise("form_field"))
        .when(button, F.when(yes(is_search), "search_button").when(yes(in_form), "form_button").otherwise("action_button"))
        .when(kind == "link", F.when(yes(is_pagination), "pagination_control").when(yes(in_nav), "navigation_link").otherwise("content_link"))
        .otherwise("interactive_element")
    )


def page_types(elements: DataFrame, page: str, role_col: str, pages: DataFrame) -> DataFrame:
    """(page, page_type) from elements' roles and a table of (page, has_table, has_article, modal_open)."""
    r = F.col(role_col)
    n = elements.groupBy(page).agg(F.count_if(r.isin(FORM_ROLES)).alias("fields"), F.count_if(r.isin("search_input", "search_button")).alias("searches"), F.count_if(r.isin("content_link", "navigation_link")).alias("links"))
    kind = (
        F.when(F.col("modal_open"), "dialog").when(F.col("fields") >= 3, "form").when((F.col("searches") > 0) & (F.col("links") > 5), "search")
        .when(F.col("has_table"), "data").when(F.col("has_article"), "article").when(F.col("links") > 15, "navigation").otherwise("mixed")
    )
    joined = pages.select(page, "has_table", "has_article", "modal_open").join(n, page, "left").fillna(0, ["fields", "searches", "links"])
    return joined.select(page, kind.alias("page_type"))


def valid_step(before: Column, after: Column) -> Column:
    """Whether a state may follow another. A first state, staying, failing and stopping always may."""
    follows = F.lit(False)
    for state, after_it in NEXT_STATES.items():
        follows = follows | (before == state) & after.isin(after_it)
    return before.isNull() | (before == after) | after.isin("FAILED", "STOPPED", "ERROR") | follows


def state_log(rows: DataFrame, session: str, order: list[str], state: str) -> DataFrame:
    """Adds before and is_valid; invalid steps are kept and flagged."""
    before = F.lag(state).over(Window.partitionBy(session).orderBy(*order))
    return rows.withColumn("before", before).withColumn("is_valid", valid_step(F.col("before"), F.col(state)))


def cause(action: Column, wanted: Column, held: Column, checked: Column, found: Column, enabled: Column, modal: Column, cookie: Column, login: Column, alert: Column, loading: Column, has_target: Column) -> Column:
    """struct<cause, strategy>: the first reason that holds. Null flags count as false, except enabled."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    done = yes(found) & (((action == "check") & yes(checked)) | ((action == "uncheck") & ~F.coalesce(checked, F.lit(True))) | (action.isin("fill", "type") & (wanted != "") & (wanted == held)))
    name = (
        F.when(yes(done), "INTENDED_CHANGE_ALREADY_DONE").when(yes(modal), "MODAL_OVERLAY").when(yes(cookie), "COOKIE_BANNER").when(yes(login), "LOGIN_REQUIRED").when(yes(alert), "VALIDATION_ERROR")
        .when(yes(loading), "PAGE_LOADING").when(~yes(found) & yes(has_target), "TARGET_DISAPPEARED").when(yes(found) & ~F.coalesce(enabled, F.lit(True)), "DISABLED_ELEMENT").otherwise("NO_EFFECT")
    )
    return F.struct(name.alias("cause"), lookup(name, STRATEGY).alias("strategy"))


# The state that each event of a task's life leads to.
LIFECYCLE = {
    "startTask": "PLANNING", "beginObserving": "OBSERVING", "beginUnderstanding": "UNDERSTANDING", "beginPlanning": "PLANNING", "waitForReasoner": "WAITING_FOR_REASONER",
    "beginValidating": "VALIDATING_ACTION", "beginExecuting": "EXECUTING_ACTION", "beginVerifying": "VERIFYING_ACTION", "waitForUser": "WAITING_FOR_USER", "waitForConfirmation": "WAITING_FOR_CONFIRMATION",
    "triggerReplanning": "REPLANNING", "markCompleted": "COMPLETED", "markBlocked": "BLOCKED", "markFailed": "FAILED", "markStopped": "STOPPED", "beginPageAnalysis": "OBSERVING",
    "evaluateReadiness": "UNDERSTANDING", "submitUserInfo": "UNDERSTANDING", "markExecuting": "EXECUTING_ACTION", "beginActionExecution": "EXECUTING_ACTION", "markWaitingForUser": "WAITING_FOR_USER", "markError": "FAILED",
}


def state_of(event: Column) -> Column:
    """The state that an event leads to, or null."""
    return lookup(event, LIFECYCLE)
