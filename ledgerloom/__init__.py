"""ledgerloom: accounts-payable control analytics as Spark DataFrame plans."""
