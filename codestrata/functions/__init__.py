"""Column functions shared by the operators. All are built-in expressions; no UDFs."""
