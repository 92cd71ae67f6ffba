"""payrecon: payment cleaning, classification and bank reconciliation as Spark plans."""
