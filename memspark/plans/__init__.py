"""memspark.plans"""
