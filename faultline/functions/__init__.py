"""Column -> Column expressions; nothing here touches a DataFrame or runs a job."""
