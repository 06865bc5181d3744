"""Registered queries: joins (survey 2.5)."""


from ..operators import selection as S
from ..sources.canonical import table
from .registry import query

USER_COLS = "u.user_id, u.username, u.email, u.first_name, u.last_name, u.is_active, u.is_staff, u.is_superuser, u.date_joined, u.last_login"


def T(spark, sf, name):
    return table(spark, sf, name)


@query("join_users_profiles", f"""
SELECT {USER_COLS}, p.user_type, p.phone, p.location, p.preferences
FROM users u JOIN profiles p ON u.user_id = p.user_id WHERE p.user_type = 'BUILDING'""")
def q_join_users_profiles(spark, sf):
    return S.join_users_profiles(T(spark, sf, "users"), T(spark, sf, "profiles"), "BUILDING")


@query("join_user_type_default", f"""
SELECT {USER_COLS}, coalesce(p.user_type, 'GENERAL') AS user_type
FROM users u LEFT JOIN profiles p ON u.user_id = p.user_id""")
def q_join_user_type_default(spark, sf):
    return S.join_user_type_default(T(spark, sf, "users"), T(spark, sf, "profiles"))


@query("join_prediction_model", """
SELECT p.*, m.name AS model_name FROM predictions p LEFT JOIN models m ON p.model_used_id = m.id""")
def q_join_prediction_model(spark, sf):
    return S.join_prediction_model(T(spark, sf, "predictions"), T(spark, sf, "models"))


@query("join_search_username", """
SELECT p.*, u.username FROM profiles p JOIN users u ON p.user_id = u.user_id
WHERE contains(lower(u.username), '00000004')""")
def q_join_search_username(spark, sf):
    return S.join_search_username(T(spark, sf, "users"), T(spark, sf, "profiles"), "00000004")


@query("semi_existing", "SELECT * FROM users u WHERE EXISTS (SELECT 1 FROM profiles p WHERE p.user_id = u.user_id)")
def q_semi_existing(spark, sf):
    return S.semi_existing(T(spark, sf, "users"), T(spark, sf, "profiles"), ["user_id"])


@query("anti_new", "SELECT * FROM users u WHERE NOT EXISTS (SELECT 1 FROM profiles p WHERE p.user_id = u.user_id)")
def q_anti_new(spark, sf):
    return S.anti_new(T(spark, sf, "users"), T(spark, sf, "profiles"), ["user_id"])
