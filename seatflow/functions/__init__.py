from seatflow.functions.columns import cents_to_currency, error_list, repeatable_id  # noqa: F401
