"""faultline: defect-prediction and repository-mining operators for PySpark."""
